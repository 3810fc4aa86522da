"""Named queries of what learning needs: factors, penalties, attention, overlaps, evaluation; with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import names
from tracewright.operators import encoders as N
from tracewright.operators import graph as G
from tracewright.operators import ranking as R
from tracewright.operators import rules
from tracewright.operators import training as L
from tracewright.operators import triples as T
from tracewright.operators import vectors as V
from tracewright.plans import catalogue, pipeline, vector_queries
from tracewright.session import shared_folder, table
from tracewright.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_E = """WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id AS h, event_type AS r, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS t, value FROM events),
  f AS (SELECT DISTINCT h, r, t FROM e)"""
_V, _J, _GRAPH = vector_queries._V, vector_queries._J, vector_queries._GRAPH


def _events(s: SparkSession, d: str) -> DataFrame:
    return T.edge_view(table(s, d, "events")).select("event_id", F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t"), "value")


def _facts(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select("h", "r", "t").distinct()


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


# ---- names and classes -----------------------------------------------------------------------------
@query("SELECT DISTINCT net_id, CASE s_ip WHEN '10.100.134.19' THEN 'front' WHEN '10.101.117.38' THEN 'back' ELSE s_ip END AS name FROM netlogs")
def address_aliases(s, d):
    known = {"10.100.134.19": "front", "10.101.117.38": "back"}
    return table(s, d, "netlogs").select("net_id", names.aliased(F.col("s_ip"), known).alias("name")).distinct()


@query("SELECT event_id, event_type AS source, 'k,u' || user_id AS fields FROM events")
def rule_key_parts(s, d):
    key = F.concat_ws("_", "event_type", F.lit("k"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    parts = table(s, d, "events").select("event_id", names.rule_parts(key).alias("p"))
    return parts.select("event_id", "p.source", F.concat_ws(",", "p.fields").alias("fields"))


@query("SELECT DISTINCT app_id, CASE WHEN contains(url, '/www/') AND ends_with(url, '.js') THEN 'script' WHEN ends_with(url, '.png') THEN 'image' END AS class FROM apachelogs")
def classes_by_ending(s, d):
    kinds = rules.equality_class(F.col("url"), {"script": ["/www/", ".js"], "image": [".png"]}, (".js", ".png"))
    return table(s, d, "apachelogs").select("app_id", kinds.alias("class")).distinct()


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS label FROM events")
def hooked_labels(s, d):
    """A labelling step that is plugged in as a function of frames."""

    def label(frame):
        return frame[["event_id"]].assign(label=np.where(frame["value"] > 50, "high", "low"))

    return pipeline.hooked(table(s, d, "events").select("event_id", "value"), label, "event_id bigint, label string")


# ---- evaluation ------------------------------------------------------------------------------------
def _scored(s, d):
    return _events(s, d).select("r", F.col("t").alias("score"), (F.col("value") + F.col("t") > 100).cast("int").alias("positive"))


@query(
    _E + """, c AS (SELECT r, t AS score, sum(CASE WHEN value + t > 100 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN value + t > 100 THEN 0 ELSE 1 END) AS q FROM e GROUP BY r, t),
    a AS (SELECT r, score, (sum(p - q) OVER (PARTITION BY r ORDER BY score) + sum(q) OVER (PARTITION BY r)) / sum(p + q) OVER (PARTITION BY r) AS a FROM c)
    SELECT r, score AS threshold, round(a, 6) AS accuracy FROM a QUALIFY row_number() OVER (PARTITION BY r ORDER BY a DESC, score) = 1"""
)
def thresholds_by_relation(s, d):
    return R.best_thresholds(_scored(s, d), "r", "score", "positive").select("r", "threshold", _r(F.col("accuracy"), "accuracy"))


@query(
    _E + """, c AS (SELECT r, t AS score, sum(CASE WHEN value + t > 100 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN value + t > 100 THEN 0 ELSE 1 END) AS q FROM e GROUP BY r, t),
    b AS (SELECT *, sum(q) OVER (PARTITION BY r ORDER BY score) - q / 2 AS b FROM c), a AS (SELECT r, sum(p * b) / (sum(p) * sum(q)) AS auc FROM b GROUP BY r)
    SELECT count(*) AS n, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std FROM a"""
)
def auc_over_trials(s, d):
    out = R.auc_over_trials(_scored(s, d), "r", "score", "positive")
    return out.select("n", _r(F.col("mean"), "mean"), _r(F.col("std"), "std"))


@query(
    """SELECT user_id AS run, round(avg(value), 4) AS fwt, round(min(value), 4) AS bwt FROM events GROUP BY user_id"""
)
def transfer_harvest(s, d):
    """Forward and backward transfer out of training logs whose names hold the run."""
    e = table(s, d, "events").groupBy("user_id").agg(F.format_string("%.4f", F.avg("value")).alias("a"), F.format_string("%.4f", F.min("value")).alias("b"))
    path = f"{shared_folder(s)}/query-{uuid4().hex}"
    text = F.concat(F.lit("epoch 1 loss 3\nFWT: "), "a", F.lit("\nBWT: "), "b", F.lit("\n"))
    e.select(F.col("user_id").alias("run"), text.alias("value")).repartition("run").write.partitionBy("run").text(path, lineSep="\n\n")
    read = readers.result_metrics(s, path, ["FWT", "BWT"])
    return read.select(F.regexp_extract("file", r"run=(\d+)", 1).cast("bigint").alias("run"), _r(F.col("FWT"), "fwt", 4), _r(F.col("BWT"), "bwt", 4))


@query(_E + ", k AS (SELECT h, event_id, value, row_number() OVER (PARTITION BY h ORDER BY value DESC, event_id) AS rank FROM e) SELECT * FROM k WHERE rank <= 5")
def top_edges(s, d):
    return R.top_k(_events(s, d).select("h", "event_id", "value"), ["h"], [F.desc("value"), F.col("event_id")], 5)


# ---- facts -----------------------------------------------------------------------------------------
@query(
    _E + """, i AS (SELECT 'e' || id AS name, row_number() OVER (ORDER BY id) - 1 AS id FROM (SELECT h AS id FROM f UNION SELECT t FROM f) q), j AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS id FROM (SELECT DISTINCT r FROM f) q)
    SELECT a.id AS h, j.id AS r, b.id AS t FROM f JOIN i a ON a.name = 'e' || f.h JOIN j USING (r) JOIN i b ON b.name = 'e' || f.t"""
)
def facts_with_ids(s, d):
    f = _facts(s, d)
    name = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    ends = f.select("h").union(f.select("t")).distinct().select(name("h").alias("name"), "h")
    entities, relations = T.first_seen_ids(ends, "name", "h"), T.first_seen_ids(f.withColumn("seq", F.col("r")), "r", "seq").withColumnRenamed("r", "name")
    return T.facts_with_ids(f.select(name("h").alias("s"), "r", name("t").alias("o")), entities, relations)


@query(
    _E + """, x AS (SELECT r, h AS e FROM f UNION SELECT r, t FROM f), p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM x a JOIN x b ON a.e = b.e AND a.r <> b.r GROUP BY a.r, b.r)
    SELECT a, b, round(n / max(n) OVER (PARTITION BY a), 6) AS share FROM p"""
)
def relation_overlap(s, d):
    return L.relation_overlap(_facts(s, d)).select("a", "b", _r(F.col("share"), "share"))


@query(
    _E + """, i AS (SELECT r, 2 * (row_number() OVER (ORDER BY r) - 1) AS id FROM (SELECT DISTINCT r FROM f) q), b AS (SELECT h, i.id AS r, t FROM f JOIN i USING (r) UNION ALL SELECT t, i.id + 1, h FROM f JOIN i USING (r)),
    g AS (SELECT h, r, count(DISTINCT t) AS n, min(t) AS least, row_number() OVER (ORDER BY h, r) - 1 AS k FROM b GROUP BY h, r) SELECT k // 64 AS batch, h, r, n, least FROM g"""
)
def golden_batches(s, d):
    f = _facts(s, d)
    ids = T.first_seen_ids(f.withColumn("seq", F.col("r")), "r", "seq").select(F.col("r").alias("name"), (F.col("id") * 2).alias("id"))
    out = T.golden_batches(f.join(ids, f.r == ids.name).select("h", F.col("id").alias("r"), "t"), 64)
    return out.select("batch", "h", "r", F.size("answers").cast("bigint").alias("n"), F.array_min("answers").alias("least"))


@query(
    catalogue._WCC + """, z AS (SELECT graph_id, component, count(*) AS n FROM c GROUP BY graph_id, component),
    b AS (SELECT graph_id, component FROM z QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, component) = 1) SELECT c.graph_id, c.node FROM c JOIN b ON b.graph_id = c.graph_id AND b.component = c.component"""
)
def largest_components(s, d):
    e = table(s, d, "edges").select("graph_id", F.concat(F.lit("s:"), "subject_name").alias("src"), F.concat(F.lit("o:"), "object_name").alias("dst")).distinct()
    return G.largest_component(e.filter("src is not null and dst is not null"), ["graph_id"])


# ---- vectors ---------------------------------------------------------------------------------------
_BLOCKS = _V + """, b AS MATERIALIZED (SELECT vec_id, (i - 1) // 16 AS k, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id, (i - 1) // 16),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, k) AS place FROM b)"""


@query(_BLOCKS + " SELECT vec_id, min(k) AS first, max(k) AS second FROM o WHERE place <= 2 GROUP BY vec_id")
def attended_factors(s, d):
    top = V.top_factors(F.col("vec"), 4, 2)
    return vector_queries.vectors(s, d).select("vec_id", F.get(top, F.lit(0)).cast("bigint").alias("first"), F.get(top, F.lit(1)).cast("bigint").alias("second"))


@query(
    _BLOCKS + """, m AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS j FROM o WHERE place <= 2)
    SELECT v.vec_id, 32 AS n, round(sum(v.x * (m.j * 16 + (v.i - 1) % 16 + 1)), 4) AS weighted FROM v JOIN m ON m.vec_id = v.vec_id AND m.k = (v.i - 1) // 16 GROUP BY v.vec_id"""
)
def gathered_factors(s, d):
    """Vectors reduced to the blocks that they attend to."""
    vec = F.col("vec")
    v = vector_queries.vectors(s, d).select("vec_id", V.gathered_factors(vec, V.top_factors(vec, 4, 2), 4).alias("g"))
    return v.select("vec_id", F.size("g").alias("n"), _r(V.total(F.transform("g", lambda x, i: x * (i + 1))), "weighted", 4))


@query(_BLOCKS + ", s AS (SELECT vec_id, place, exp(n) / sum(exp(n)) OVER (PARTITION BY vec_id) AS s FROM o) SELECT vec_id, round(1 - sum(CASE WHEN place <= 2 THEN s ELSE 0 END), 6) AS rest FROM s GROUP BY vec_id")
def attention_rest(s, d):
    return vector_queries.vectors(s, d).select("vec_id", _r(V.unattended(F.col("vec"), 4, 2), "rest"))


@query(_V + _J + " SELECT vec_id, round(sum((h * abs(t) + h) / (1 + abs(t))), 6) AS total, round(sum((h * abs(t) + h) / (1 + abs(t)) * i), 4) AS weighted FROM j GROUP BY vec_id")
def cwr_consolidated(s, d):
    c = vector_queries.chains(s, d).select("vec_id", V.consolidated(F.col("h"), F.transform("t", F.abs)).alias("c"))
    return c.select("vec_id", _r(V.total(F.col("c")), "total"), _r(V.total(F.transform("c", lambda x, i: x * (i + 1))), "weighted", 4))


@query(
    _V + _J + """ SELECT vec_id, round(sum(r * r * (h - t) * (h - t)), 6) AS ewc, round(sum((r * r + q * q * 3 + 1) / 5), 6) AS fisher,
    round(sum(abs(q) + r * r / ((h - t) * (h - t) + 0.1)), 6) AS omega, round(sum(pow((h - t) * 3 / (vec_id % 5 + 3), 2)), 6) AS lkge FROM j GROUP BY vec_id"""
)
def lifelong_penalties(s, d):
    """Penalty and importance of the strategies that pull rows back: squared gradients, paths and counts."""
    h, t, r, q = (F.col(c) for c in "htrq")
    square = lambda v: F.transform(v, lambda x: x * x)
    return vector_queries.chains(s, d).select(
        "vec_id", _r(V.importance_penalty(h, t, square(r)), "ewc"), _r(V.total(V.fisher_merged(square(r), square(q), 3)), "fisher"),
        _r(V.total(V.path_importance(F.transform(q, F.abs), square(r), V.minus(h, t))), "omega"), _r(V.count_penalty(h, t, F.lit(3), F.col("vec_id") % 5), "lkge"),
    )


@query(
    _V + """, z AS (SELECT vec_id, i, (x - ln(-ln((i * 7 + vec_id) % 97 / 100 + 0.01))) / 0.5 AS z FROM v), g AS (SELECT vec_id, i, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS g FROM z)
    SELECT vec_id, round(sum(g), 6) AS whole, round(sum(g * i), 5) AS weighted FROM g GROUP BY vec_id"""
)
def gumbel_weights(s, d):
    noise = F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: (i * 7 + F.col("vec_id")) % 97 / 100 + 0.01)
    g = vector_queries.vectors(s, d).select("vec_id", V.gumbel_softmax(F.col("vec"), noise, 0.5).alias("g"))
    return g.select("vec_id", _r(V.total(F.col("g")), "whole"), _r(V.total(F.transform("g", lambda x, i: x * (i + 1))), "weighted", 5))


@query(
    _V + """, n AS MATERIALIZED (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id), w AS MATERIALIZED (SELECT vec_id, i, x / n AS x FROM v JOIN n USING (vec_id)),
    s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id - 1 AS b, exp(sum(a.x * b.x) / 0.2) AS s FROM w a JOIN w b ON a.i = b.i WHERE a.vec_id % 10 = 0 AND (b.vec_id - 1) % 10 = 0
      AND a.vec_id + 1 IN (SELECT vec_id FROM n) GROUP BY a.vec_id, b.vec_id),
    g AS (SELECT a, s AS good FROM s WHERE a = b), o AS (SELECT a, sum(s) - max(CASE WHEN a = b THEN s END) AS rest FROM s GROUP BY a), p AS (SELECT b, sum(s) - max(CASE WHEN a = b THEN s END) AS rest FROM s GROUP BY b)
    SELECT g.a AS vec_id, round((-ln(good / o.rest) - ln(good / p.rest)) / 2, 6) AS loss FROM g JOIN o ON o.a = g.a JOIN p ON p.b = g.a"""
)
def contrastive_losses(s, d):
    """Every tenth vector against the one after it, in one batch."""
    whole = vector_queries.vectors(s, d)
    pairs = whole.select("vec_id", F.col("vec").alias("a")).join(whole.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b")), "vec_id").filter("vec_id % 10 = 0")
    return N.contrastive_by_batch(pairs, "vec_id", 1 << 20).select("vec_id", _r(F.col("loss"), "loss"))


_ATT = _GRAPH + """, l AS MATERIALIZED (SELECT g, node, sum(x * (i % 3)) / 10 AS s, sum(x * (i % 5)) / 10 AS t FROM n GROUP BY g, node),
  u AS (SELECT g, node, other FROM b UNION SELECT g, node, node FROM n), z AS MATERIALIZED (SELECT u.g, u.node, u.other, exp(CASE WHEN a.s + c.t > 0 THEN a.s + c.t ELSE 0.2 * (a.s + c.t) END) AS w
    FROM u JOIN l a ON a.g = u.g AND a.node = u.node JOIN l c ON c.g = u.g AND c.node = u.other), y AS (SELECT *, w / sum(w) OVER (PARTITION BY g, node) AS a FROM z)"""


@query(_ATT + " SELECT y.g, y.node, round(sum(y.a * n.x), 5) AS total, round(sum(y.a * n.x * n.i), 4) AS weighted FROM y JOIN n ON n.g = y.g AND n.node = y.other GROUP BY y.g, y.node")
def graph_attention(s, d):
    nodes, edges = vector_queries._graph(s, d)
    i = np.arange(1, 65)
    out = N.attention_layer(nodes, edges, ["g"], np.eye(64), (i % 3) / 10, (i % 5) / 10)
    return out.select("g", "node", _r(V.total(F.col("vec")), "total", 5), _r(V.total(F.transform("vec", lambda x, k: x * (k + 1))), "weighted", 4))


@query(_V + " SELECT vec_id, round(sum(x * (i % 2)) + 1, 6) AS odd, round(sum(x * ((i + 1) % 2)) - 1, 6) AS even FROM v GROUP BY vec_id")
def class_logits(s, d):
    i = np.arange(1, 65)
    out = N.logits(vector_queries.vectors(s, d), "vec_id", np.stack([i % 2, (i + 1) % 2], 1).astype(float), np.array([1.0, -1.0]))
    return out.select("vec_id", _r(F.get("vec", F.lit(0)), "odd"), _r(F.get("vec", F.lit(1)), "even"))


_REC = _E + """, v AS (SELECT vec_id AS id, CAST(x AS DOUBLE) AS x, i FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q),
  k AS (SELECT DISTINCT h, r, t FROM f WHERE h < 400 AND t < 400), rid AS (SELECT r, 400 + row_number() OVER (ORDER BY r) AS id FROM (SELECT DISTINCT r FROM k) q),
  a AS (SELECT k.t AS id, h.i, h.x + r.x AS x FROM k JOIN v h ON h.id = k.h JOIN rid USING (r) JOIN v r ON r.id = rid.id AND r.i = h.i UNION ALL SELECT id, i, x FROM v WHERE id < 400)"""


def _model(s, d):
    v = vector_queries.vectors(s, d)
    f = _facts(s, d).filter("h < 400 and t < 400")
    ids = T.first_seen_ids(f.select("r").distinct().withColumn("seq", F.col("r")), "r", "seq").select("r", (F.col("id") + 401).alias("vec_id"))
    relations = ids.join(v.select("vec_id", "vec"), "vec_id").select(F.col("r").alias("id"), "vec")
    return f, v.filter("vec_id < 400").select(F.col("vec_id").alias("id"), "vec"), relations


@query(_REC + ", m AS (SELECT id, i, greatest(avg(x), 0) AS x FROM a GROUP BY id, i) SELECT id, round(sum(x * i), 4) AS weighted FROM m GROUP BY id")
def entities_reconstructed(s, d):
    """Entities as the mean of head and relation over their incoming facts and themselves."""
    f, entities, relations = _model(s, d)
    out, _ = L.reconstructed(f, entities, relations)
    return out.select("id", _r(V.total(F.transform("vec", lambda x, k: x * (k + 1))), "weighted", 4))


@query(_REC + " SELECT k.r AS id, round(sum(d.x * i) / count(DISTINCT (k.h, k.t)), 4) AS weighted FROM k, LATERAL (SELECT t.i, t.x - h.x AS x FROM v t JOIN v h ON h.i = t.i WHERE t.id = k.t AND h.id = k.h) d GROUP BY k.r")
def relations_reconstructed(s, d):
    """Relations as the mean of tail minus head over their facts."""
    f, entities, relations = _model(s, d)
    _, out = L.reconstructed(f, entities, relations)
    return out.select("id", _r(V.total(F.transform("vec", lambda x, k: x * (k + 1))), "weighted", 4))


@query("SELECT CASE WHEN vec_id < 300 THEN 'entity' ELSE 'relation' END AS kind, CASE WHEN vec_id < 300 THEN vec_id ELSE vec_id - 300 END AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE vec_id < 310")
def model_written(s, d):
    """A model stored as tables, loaded and stored again."""
    v = vector_queries.vectors(s, d).filter("vec_id < 310")
    tables = v.select(F.when(F.col("vec_id") < 300, "entity").otherwise("relation").alias("kind"), F.when(F.col("vec_id") < 300, F.col("vec_id")).otherwise(F.col("vec_id") - 300).alias("id"), "vec")
    path = f"{shared_folder(s)}/query-{uuid4().hex}"
    writers.dictionary(L.model_tables(s, L.model_from(tables)), path)
    return s.read.parquet(path).select("kind", "id", _r(V.total(F.col("vec")), "total", 5))

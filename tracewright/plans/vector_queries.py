"""Named queries over vectors: scores, ranks, clusters, detection, evaluation; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import clusters as K
from tracewright.operators import encoders as N
from tracewright.operators import ranking as R
from tracewright.operators import triples as T
from tracewright.operators import vectors as V
from tracewright.plans import pipeline
from tracewright.session import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_V = """WITH v AS MATERIALIZED (SELECT vec_id, label, CAST(x AS DOUBLE) AS x, i FROM
  (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q)"""
_C = _V + ", c AS MATERIALIZED (SELECT label, i, avg(x) AS x FROM v GROUP BY label, i)"
_A = _C + """, d AS MATERIALIZED (SELECT v.vec_id, v.label AS own, c.label, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c USING (i) GROUP BY v.vec_id, v.label, c.label),
  a AS (SELECT vec_id, own, label, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM d) q WHERE k = 1)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def chains(spark: SparkSession, d: str) -> DataFrame:
    """Vector i as head, i + 1 as tail, i + 2 and i + 3 as relation vectors."""
    v = vectors(spark, d)
    out = v.select("vec_id", F.col("vec").alias("h"))
    for name, step in (("t", 1), ("r", 2), ("q", 3)):
        out = out.join(v.select((F.col("vec_id") - step).alias("vec_id"), F.col("vec").alias(name)), "vec_id")
    return out


def _score(spark: SparkSession, d: str, score) -> DataFrame:
    return chains(spark, d).select("vec_id", F.round(score, 6).alias("score"))


#: One row per chain and element, each vector joined by key and element after its key is shifted.
_J = """, j AS MATERIALIZED (SELECT vec_id, i, h, t, r, q FROM (SELECT vec_id, i, x AS h FROM v) a
  JOIN (SELECT vec_id - 1 AS vec_id, i, x AS t FROM v) b USING (vec_id, i) JOIN (SELECT vec_id - 2 AS vec_id, i, x AS r FROM v) c USING (vec_id, i)
  JOIN (SELECT vec_id - 3 AS vec_id, i, x AS q FROM v) d USING (vec_id, i))"""


@query(
    _V + _J + """, n AS (SELECT vec_id, sqrt(sum(h * h)) AS nh, sqrt(sum(t * t)) AS nt, sqrt(sum(r * r)) AS nr FROM j GROUP BY vec_id)
    SELECT vec_id, round(sum(abs(h / nh + r / nr - t / nt)), 6) AS score FROM j JOIN n USING (vec_id) GROUP BY vec_id"""
)
def transe_scores(s, d):
    return _score(s, d, V.transe(F.col("h"), F.col("r"), F.col("t")))


@query(_V + _J + " SELECT vec_id, round(sum(h * r * t), 6) AS score FROM j GROUP BY vec_id")
def distmult_scores(s, d):
    return _score(s, d, V.distmult(F.col("h"), F.col("r"), F.col("t")))


@query(_V + _J + " SELECT vec_id, round((sum(h * r * t) + sum(h * q * t)) / 2, 6) AS score FROM j GROUP BY vec_id")
def simple_scores(s, d):
    return _score(s, d, V.simple_score(F.col("h"), F.col("r"), F.col("q"), F.col("t")))


_HALF = _V + _J + """, w AS (SELECT a.vec_id, a.h AS h1, b.h AS h2, a.t AS t1, b.t AS t2, a.r AS r1, b.r AS r2
  FROM j a JOIN (SELECT vec_id, i - 32 AS i, h, t, r FROM j) b USING (vec_id, i))"""


@query(_HALF + " SELECT vec_id, round(sum(h1 * r1 * t1 + h2 * r1 * t2 + h1 * r2 * t2 - h2 * r2 * t1), 6) AS score FROM w GROUP BY vec_id")
def complex_scores(s, d):
    return _score(s, d, V.complex_score(F.col("h"), F.col("r"), F.col("t")))


@query(
    _HALF + """ SELECT vec_id, round(6 - sum(sqrt(pow(h1 * cos(r1) - h2 * sin(r1) - t1, 2) + pow(h1 * sin(r1) + h2 * cos(r1) - t2, 2))), 6) AS score
    FROM w GROUP BY vec_id"""
)
def rotate_scores(s, d):
    return _score(s, d, V.rotate(F.col("h"), F.slice("r", 1, 32), F.col("t"), 6.0))


@query(_V + _J + ", x AS (SELECT vec_id, sum(h * r) AS hr, sum(r * t) AS rt FROM j GROUP BY vec_id) SELECT vec_id, round(-hr * rt, 6) AS score FROM x")
def rescal_scores(s, d):
    # The relation's matrix is the outer product of its vector with itself.
    spread = chains(s, d).withColumn("r2", F.array_repeat("r", F.size("r")))
    matrix = F.flatten(F.zip_with("r2", "r", lambda row, a: F.transform(row, lambda b: a * b)))
    return stored(spread.withColumn("m", matrix)).select("vec_id", F.round(V.rescal(F.col("h"), F.col("m"), F.col("t")), 6).alias("score"))


@query(
    _V + _J + """, x AS (SELECT a.vec_id, (b.i - a.i + 64) % 64 + 1 AS i, a.h * b.t AS p FROM j a JOIN (SELECT vec_id, i, t FROM j) b ON a.vec_id = b.vec_id)
    SELECT x.vec_id, round(sum(r * p), 6) AS score FROM x JOIN (SELECT vec_id, i, r FROM j) y USING (vec_id, i) GROUP BY x.vec_id"""
)
def hole_scores(s, d):
    return _score(s, d, V.hole(F.col("h"), F.col("r"), F.col("t")))


@query(
    _V + _J + """, n AS (SELECT vec_id, sqrt(sum(q * q)) AS nq FROM j GROUP BY vec_id), y AS (SELECT vec_id, h, t, r, q / nq AS w FROM j JOIN n USING (vec_id)),
    z AS (SELECT vec_id, sum(h * w) AS hw, sum(t * w) AS tw FROM y GROUP BY vec_id),
    p AS (SELECT vec_id, h - hw * w AS h, t - tw * w AS t, r FROM y JOIN z USING (vec_id)),
    l AS (SELECT vec_id, sqrt(sum(h * h)) AS nh, sqrt(sum(t * t)) AS nt, sqrt(sum(r * r)) AS nr FROM p GROUP BY vec_id)
    SELECT vec_id, round(sum(abs(h / nh + r / nr - t / nt)), 6) AS score FROM p JOIN l USING (vec_id) GROUP BY vec_id"""
)
def transh_scores(s, d):
    return _score(s, d, V.transh(F.col("h"), F.col("r"), F.col("t"), F.col("q")))


@query(_V + " SELECT round(sum(x * x) / count(*), 6) AS mean_square, round(sum(abs(x) * x * x), 4) AS l3 FROM v")
def regularization_terms(s, d):
    return V.regularization(vectors(s, d)).select(F.round("mean_square", 6).alias("mean_square"), F.round("l3", 4).alias("l3"))


@query(
    """SELECT event_id, round(greatest(value - value / 2, -1) + 1, 6) AS margin_loss,
    round((ln(1 + exp(-value / 100)) + ln(1 + exp(value / 200))) / 2, 6) AS sigmoid_loss FROM events"""
)
def loss_terms(s, d):
    p, n = F.col("value"), F.col("value") / 2
    margin, log = V.margin_loss(p, n, 1.0), V.sigmoid_loss(p / 100, n / 100)
    return table(s, d, "events").select("event_id", F.round(margin, 6).alias("margin_loss"), F.round(log, 6).alias("sigmoid_loss"))


@query(
    _V + _J + """, m AS MATERIALIZED (SELECT vec_id, (i - 1) // 8 + 1 AS a, (i - 1) % 8 + 1 AS b, q AS w FROM j), s AS MATERIALIZED (SELECT vec_id, i, h, t, r FROM j WHERE i <= 8),
    p AS (SELECT m.vec_id, m.b AS i, sum(s.h * w) AS h, sum(s.t * w) AS t FROM m JOIN s ON s.vec_id = m.vec_id AND s.i = m.a GROUP BY m.vec_id, m.b),
    y AS (SELECT p.vec_id, p.i, p.h, p.t, s.r FROM p JOIN s ON s.vec_id = p.vec_id AND s.i = p.i),
    n AS (SELECT vec_id, sqrt(sum(h * h)) AS nh, sqrt(sum(t * t)) AS nt, sqrt(sum(r * r)) AS nr FROM y GROUP BY vec_id)
    SELECT vec_id, round(sum(abs(h / nh + r / nr - t / nt)), 6) AS score FROM y JOIN n USING (vec_id) GROUP BY vec_id"""
)
def transr_scores(s, d):
    """Eight elements of each vector, projected by an 8 x 8 matrix."""
    cut = lambda c: F.slice(c, 1, 8)
    return _score(s, d, V.transr(cut(F.col("h")), cut(F.col("r")), cut(F.col("t")), F.col("q")))


@query(
    _V + _J + """, k AS (SELECT vec_id, sum(h * q) AS hq, sum(t * q) AS tq FROM j GROUP BY vec_id), p AS (SELECT vec_id, h + hq * q AS h, t + tq * q AS t, r FROM j JOIN k USING (vec_id)),
    n AS (SELECT vec_id, sqrt(sum(h * h)) AS nh, sqrt(sum(t * t)) AS nt, sqrt(sum(r * r)) AS nr FROM p GROUP BY vec_id)
    SELECT vec_id, round(sum(abs(h / nh + r / nr - t / nt)), 6) AS score FROM p JOIN n USING (vec_id) GROUP BY vec_id"""
)
def transd_scores(s, d):
    return _score(s, d, V.transd(F.col("h"), F.col("r"), F.col("t"), F.col("q"), F.col("q"), F.col("q")))


@query(
    _HALF + """, c AS (SELECT vec_id, sum(h1 * r1 * t1 + h2 * r1 * t2 + h1 * r2 * t2 - h2 * r2 * t1) AS c FROM w GROUP BY vec_id),
    e AS (SELECT vec_id, sum(h * q * t) AS e FROM j GROUP BY vec_id) SELECT vec_id, round(-c - e, 6) AS score FROM c JOIN e USING (vec_id)"""
)
def analogy_scores(s, d):
    return _score(s, d, V.analogy(F.col("h"), F.col("r"), F.col("t"), F.col("h"), F.col("q"), F.col("t")))


@query(_V + _J + " SELECT vec_id, round(-sum(h * r * t), 6) AS product, round(6 - sum(h * t), 6) AS undone FROM j GROUP BY vec_id")
def predicted_scores(s, d):
    h, r, t = F.col("h"), F.col("r"), F.col("t")
    return chains(s, d).select(
        "vec_id", F.round(V.predict(V.distmult(h, r, t), False), 6).alias("product"), F.round(V.predict(V.dot(h, t), True, 6.0), 6).alias("undone")
    )


@query(_V + " SELECT vec_id, 70 AS n, round(sum(CASE WHEN i <= 70 THEN x ELSE 0 END), 6) AS total, round(sum(CASE WHEN i <= 10 THEN x ELSE 0 END), 6) AS head FROM v GROUP BY vec_id")
def padded_vectors(s, d):
    long, short = V.padded(F.col("vec"), 70), V.padded(F.col("vec"), 10)
    return vectors(s, d).select("vec_id", F.size(long).alias("n"), F.round(V.total(long), 6).alias("total"), F.round(V.total(short), 6).alias("head"))


@query(_A + " SELECT vec_id, label, round(ln((d + 1) / (d + 1e-4)), 6) AS similarity FROM a")
def prototype_similarities(s, d):
    d_ = F.col("distance")
    return _assigned(s, d).select("vec_id", "label", F.round(F.log((d_ + 1) / (d_ + 1e-4)), 6).alias("similarity"))


@query("SELECT event_id, round(ln(1 + exp(-value / 50)) / 2 + ln(1 + exp(value / 100)) / 2, 6) AS softplus FROM events")
def softplus_losses(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.round(V.softplus_loss(F.col("value") / 50, F.col("value") / 100), 6).alias("softplus"))


@query(
    """WITH n AS (SELECT event_id, user_id, value / 100 AS x FROM events), w AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY user_id) AS w FROM n)
    SELECT user_id, round(sum(w * ln(1 + exp(x))), 6) AS loss FROM w GROUP BY user_id"""
)
def self_adversarial_losses(s, d):
    """Negatives of one positive weigh by the softmax of their scores."""
    n = table(s, d, "events").select("user_id", (F.col("value") / 100).alias("score"))
    return V.self_adversarial(n, ["user_id"], "score").select("user_id", F.round("loss", 6).alias("loss"))


@query(
    _V + _J + """, a AS (SELECT sum(h * h) AS hh, sum(t * t) AS tt, sum(r * r) AS rr, count(*) AS n FROM j) SELECT round((hh / n + tt / n + rr / n) / 3, 6) AS reg FROM a"""
)
def regularization_of_parts(s, d):
    """The mean of squares over the vectors taking part, averaged over heads, tails and relations."""
    return V.regularization_of(chains(s, d), ["h", "t", "r"]).select(F.round("reg", 6).alias("reg"))


_GRAPH = """WITH e AS (SELECT event_type AS g, user_id AS src, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst FROM events),
  p AS (SELECT g, src AS node FROM e UNION SELECT g, dst FROM e), v AS (SELECT vec_id AS node, CAST(x AS DOUBLE) AS x, i FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q),
  n AS MATERIALIZED (SELECT p.g, p.node, i, x FROM p JOIN v USING (node)), b AS (SELECT g, src AS node, dst AS other FROM e UNION ALL SELECT g, dst, src FROM e),
  s AS (SELECT b.g, b.node, n.i, sum(n.x) AS near FROM b JOIN n ON n.g = b.g AND n.node = b.other GROUP BY b.g, b.node, n.i),
  t AS MATERIALIZED (SELECT n.g, n.node, n.i, n.x + coalesce(near, 0) AS x FROM n LEFT JOIN s ON s.g = n.g AND s.node = n.node AND s.i = n.i)"""


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = T.edge_view(table(s, d, "events")).select(F.col("rel").alias("g"), "src", "dst")
    ends = edges.select("g", F.col("src").alias("node")).union(edges.select("g", "dst")).distinct()
    return ends.join(vectors(s, d).select(F.col("vec_id").alias("node"), "vec"), "node").select("g", "node", "vec"), edges


@query(_GRAPH + " SELECT g, node, round(sum(x), 5) AS total, round(sum(x * i), 4) AS weighted FROM t GROUP BY g, node")
def neighbour_sums(s, d):
    nodes, edges = _graph(s, d)
    out = N.neighbour_sum(nodes, edges, ["g"])
    weighted = V.total(F.transform("vec", lambda x, i: x * (i + 1)))
    return out.select("g", "node", F.round(V.total(F.col("vec")), 5).alias("total"), F.round(weighted, 4).alias("weighted"))


@query(_GRAPH + ", r AS (SELECT g, node, i, greatest(0.5 * x - 0.1, 0) AS x FROM t) SELECT g, i, round(sum(x), 4) AS x FROM r GROUP BY g, i")
def graph_encoding(s, d):
    """One layer with half the identity as weights, summed over the nodes of each graph."""
    nodes, edges = _graph(s, d)
    out = N.encode_graphs(nodes, edges, ["g"], [(np.eye(64) * 0.5, np.full(64, -0.1))])
    return out.select("g", F.posexplode("vec").alias("i", "x")).select("g", (F.col("i") + 1).alias("i"), F.round("x", 4).alias("x"))


@query(
    """WITH e AS (SELECT event_id, user_id AS g, event_type AS r, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
    c AS (SELECT g, r, k, count(*) AS n FROM e GROUP BY g, r, k), w AS (SELECT r, k, count(DISTINCT g) AS df, (SELECT count(DISTINCT g) FROM e) AS n FROM e GROUP BY r, k),
    z AS (SELECT r, k, df / n * log10((n + 1) / (df + 1)) AS w FROM w), v AS (SELECT vec_id, CAST(x AS DOUBLE) AS x, i FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q)
    SELECT c.g AS graph_id, round(sum(c.n * z.w * v.x * v.i), 5) AS weighted FROM c JOIN z USING (r, k) JOIN v ON v.vec_id = c.k GROUP BY c.g"""
)
def graph_pool(s, d):
    """Graph vectors: weighted sums of the vectors of a graph's triples (here: the vector of the object)."""
    e = T.edge_view(table(s, d, "events")).select(F.col("src").alias("graph_id"), F.lit("x").alias("src"), F.col("rel").alias("relation"), "dst")
    v = e.select("src", "relation", "dst").distinct().join(vectors(s, d).select(F.col("vec_id").alias("dst"), "vec"), "dst")
    out = pipeline.pool(e, v)
    return out.select("graph_id", F.round(V.total(F.transform("vec", lambda x, i: x * (i + 1))), 5).alias("weighted"))


@query()
def agglomerative_clusters(s, d):
    """Average linkage within each label, three clusters each."""
    return N.agglomerative(vectors(s, d), ["label"], "vec_id", 3)


# ---- ranks -----------------------------------------------------------------------------------------
_RANK = _V + _J + """, o AS MATERIALIZED (SELECT vec_id AS q, i, h + r AS x FROM j WHERE vec_id % 20 = 0),
  g AS MATERIALIZED (SELECT o.q, e.vec_id AS e, sum(abs(o.x - e.x)) AS d FROM o JOIN v e ON e.i = o.i GROUP BY o.q, e.vec_id),
  t AS (SELECT q, d AS own FROM g WHERE e = q + 1),
  k AS (SELECT q AS query_id, 1 + sum(CASE WHEN d < own THEN 1 ELSE 0 END) AS rank,
    1 + sum(CASE WHEN d < own AND e <> q THEN 1 ELSE 0 END) AS filtered_rank FROM t JOIN g USING (q) GROUP BY q)"""


def _ranked(s, d):
    asked = chains(s, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), V.plus(F.col("h"), F.col("r")).alias("query"), (F.col("vec_id") + 1).alias("target"))
    known = asked.select("query_id", F.col("query_id").alias("id"))
    return R.ranks(asked, vectors(s, d).select(F.col("vec_id").alias("id"), "vec"), known)


@query(_RANK + " SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(filtered_rank AS BIGINT) AS filtered_rank FROM k")
def link_ranks(s, d):
    return _ranked(s, d)


@query(
    _RANK + """ SELECT count(*) AS n, round(avg(filtered_rank), 6) AS mr, round(avg(1 / filtered_rank), 6) AS mrr,
    round(avg(CASE WHEN filtered_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hits_1, round(avg(CASE WHEN filtered_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits_3,
    round(avg(CASE WHEN filtered_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_10 FROM k"""
)
def link_rank_mrr_hits(s, d):
    m = R.rank_metrics(_ranked(s, d))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


def _rank_sql(query: str, target: str, other: str) -> str:
    return _V + _J + f""", o AS MATERIALIZED (SELECT vec_id AS q, i, {query} AS x FROM j WHERE vec_id % 20 = 0),
      g AS MATERIALIZED (SELECT o.q, e.vec_id AS e, sum(abs(o.x - e.x)) AS d FROM o JOIN v e ON e.i = o.i GROUP BY o.q, e.vec_id),
      t AS (SELECT q, d AS own FROM g WHERE e = {target}),
      k AS (SELECT q AS query_id, 1 + count(*) FILTER (d < own) AS rank, 1 + count(*) FILTER (d < own AND e <> {other}) AS filtered_rank,
        1 + count(*) FILTER (d < own AND (e % 3 = q % 3 OR e = {target})) AS typed_rank,
        1 + count(*) FILTER (d < own AND e <> {other} AND (e % 3 = q % 3 OR e = {target})) AS typed_filtered_rank FROM t JOIN g USING (q) GROUP BY q)"""


def _typed_ranks(s, d, query, step: int, other: int) -> DataFrame:
    """Ranks of target vec_id + step; candidates of a query's kind have its remainder by 3 or are its own target."""
    asked = chains(s, d).filter("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), query.alias("query"), (F.col("vec_id") + step).alias("target"), (F.col("vec_id") % 3).alias("remainder"), F.col("vec_id").alias("kind")
    )
    known = asked.select("query_id", (F.col("query_id") + other).alias("id"))
    ids = vectors(s, d).select(F.col("vec_id").alias("id"), "vec")
    allowed = asked.select("query_id", "remainder").join(ids.select("id", (F.col("id") % 3).alias("remainder")), "remainder").select("query_id", "id").union(asked.select("query_id", "target")).distinct()
    kinds = allowed.groupBy("id").agg(F.collect_list("query_id").alias("kinds"))
    return R.ranks(asked.drop("remainder"), ids.join(kinds, "id", "left"), known)


_OUT = " SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(filtered_rank AS BIGINT) AS filtered_rank, CAST(typed_rank AS BIGINT) AS typed_rank, CAST(typed_filtered_rank AS BIGINT) AS typed_filtered_rank FROM k"


@query(_rank_sql("h + r", "q + 1", "q") + _OUT)
def tail_ranks_typed(s, d):
    return _typed_ranks(s, d, V.plus(F.col("h"), F.col("r")), 1, 0)


@query(_rank_sql("t - r", "q", "q + 1") + _OUT)
def head_ranks_typed(s, d):
    return _typed_ranks(s, d, V.minus(F.col("t"), F.col("r")), 0, 1)


@query(_rank_sql("t - h", "q + 2", "q") + " SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(filtered_rank AS BIGINT) AS filtered_rank FROM k")
def relation_ranks(s, d):
    """Which relation vector leads from head to tail."""
    asked = chains(s, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), V.minus(F.col("t"), F.col("h")).alias("query"), (F.col("vec_id") + 2).alias("target"))
    return R.ranks(asked, vectors(s, d).select(F.col("vec_id").alias("id"), "vec"), asked.select("query_id", F.col("query_id").alias("id")))


_LINKS = _V + """, test AS MATERIALIZED (SELECT vec_id AS q, vec_id AS h, vec_id + 2 AS r, vec_id + 1 AS t FROM (SELECT DISTINCT vec_id FROM v) z WHERE vec_id % 20 = 0 AND vec_id + 2 IN (SELECT vec_id FROM v)),
  known AS MATERIALIZED (SELECT h, r, t FROM test UNION SELECT h, r, (t + 40) % 400 FROM test UNION SELECT (h + 60) % 400, r, t FROM test),
  o AS MATERIALIZED (SELECT q, 'tail' AS side, h.i, h.x + r.x AS x, t AS target FROM test JOIN v h ON h.vec_id = test.h JOIN v r ON r.vec_id = test.r AND r.i = h.i
    UNION ALL SELECT q, 'head', t.i, t.x - r.x, h FROM test JOIN v t ON t.vec_id = test.t JOIN v r ON r.vec_id = test.r AND r.i = t.i),
  g AS MATERIALIZED (SELECT o.q, side, target, e.vec_id AS e, sum(abs(o.x - e.x)) AS d FROM o JOIN v e ON e.i = o.i GROUP BY o.q, side, target, e.vec_id),
  w AS (SELECT q, side, d AS own FROM g WHERE e = target),
  x AS MATERIALIZED (SELECT g.*, own, test.h, test.r, test.t FROM g JOIN w ON w.q = g.q AND w.side = g.side JOIN test ON test.q = g.q WHERE d < own),
  k AS (SELECT t.q, t.side, 1 + count(x.e) FILTER (NOT EXISTS (SELECT 1 FROM known n WHERE n.r = x.r AND CASE WHEN x.side = 'tail' THEN n.h = x.h AND n.t = x.e ELSE n.t = x.t AND n.h = x.e END)) AS rank,
    1 + count(x.e) FILTER (NOT EXISTS (SELECT 1 FROM known n WHERE n.r = x.r AND CASE WHEN x.side = 'tail' THEN n.h = x.h AND n.t = x.e ELSE n.t = x.t AND n.h = x.e END)
      AND EXISTS (SELECT 1 FROM known n WHERE n.r = x.r AND CASE WHEN x.side = 'tail' THEN n.t ELSE n.h END = x.e)) AS typed
    FROM w t LEFT JOIN x ON x.q = t.q AND x.side = t.side GROUP BY t.q, t.side)
  SELECT side, count(*) AS n, round(avg({rank}), 6) AS mr, round(avg(1 / {rank}), 6) AS mrr, round(avg(CASE WHEN {rank} <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_10 FROM k GROUP BY side"""


def _links(s, d, typed):
    v = vectors(s, d).select(F.col("vec_id").alias("id"), "vec")
    ids = v.select("id")
    test = ids.filter("id % 20 = 0").join(ids.select((F.col("id") - 2).alias("id")), "id").select(F.col("id").alias("fact_id"), F.col("id").alias("h"), (F.col("id") + 2).alias("r"), (F.col("id") + 1).alias("t"))
    facts = test.select("h", "r", "t")
    known = facts.union(facts.select("h", "r", (F.col("t") + 40) % 400)).union(facts.select((F.col("h") + 60) % 400, "r", "t")).distinct()
    out = R.link_prediction(test, known, v, v, typed)
    return out.select("side", "n", F.round("mr", 6).alias("mr"), F.round("mrr", 6).alias("mrr"), F.round("hits_10", 6).alias("hits_10"))


@query(_LINKS.format(rank="rank"))
def link_prediction(s, d):
    """Heads and tails of facts ranked among all entities, known facts left out."""
    return _links(s, d, False)


@query(_LINKS.format(rank="typed"))
def link_prediction_typed(s, d):
    """As ``link_prediction`` among the entities that the relation was seen with."""
    return _links(s, d, True)


@query(
    _RANK + """ SELECT query_id // 100 AS relation, count(*) AS n, round(avg(filtered_rank), 6) AS mr, round(avg(1 / filtered_rank), 6) AS mrr,
    round(avg(CASE WHEN filtered_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_10 FROM k GROUP BY 1"""
)
def rank_metrics_by_relation(s, d):
    ranked = _ranked(s, d).withColumn("relation", F.floor(F.col("query_id") / 100))
    out = R.rank_metrics(ranked, hits=(10,), by=["relation"])
    return out.select("relation", "n", F.round("mr", 6).alias("mr"), F.round("mrr", 6).alias("mrr"), F.round("hits_10", 6).alias("hits_10"))


def _scored(s, d):
    e = T.edge_view(table(s, d, "events"))
    return e.select(F.col("dst").alias("score"), (F.col("value") + F.col("dst") > 100).cast("int").alias("positive"))


_SC = """WITH z AS (SELECT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS score, value FROM events),
  z2 AS (SELECT score, CASE WHEN value + score > 100 THEN 1 ELSE 0 END AS positive FROM z)"""


@query(
    _SC + """, c AS (SELECT score, sum(positive) AS p, sum(1 - positive) AS q FROM z2 GROUP BY score),
    r AS (SELECT score, (sum(p - q) OVER (ORDER BY score) + (SELECT sum(1 - positive) FROM z2)) / (SELECT count(*) FROM z2) AS a FROM c)
    SELECT score AS threshold, round(a, 6) AS accuracy FROM r ORDER BY a DESC, score LIMIT 1"""
)
def triple_classification_threshold(s, d):
    return R.best_threshold(_scored(s, d), "score", "positive").select("threshold", F.round("accuracy", 6).alias("accuracy"))


@query(
    _SC + """, c AS (SELECT score, sum(positive) AS p, count(*) - sum(positive) AS q FROM z2 GROUP BY score),
    r AS (SELECT p, q, sum(q) OVER (ORDER BY score) AS u FROM c) SELECT round(sum(p * (u - q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM r"""
)
def roc_auc(s, d):
    return R.auc(_scored(s, d), "score", "positive").select(F.round("auc", 6).alias("auc"))


# ---- clusters --------------------------------------------------------------------------------------
def _assigned(s, d):
    v = vectors(s, d)
    return K.assign(v, K.centroids(v, "label"), "vec_id", "label")


@query(_A + " SELECT vec_id, label, round(d, 6) AS distance FROM a")
def nearest_centroid_assign(s, d):
    return _assigned(s, d).withColumn("distance", F.round("distance", 6))


@query(_A + " SELECT label, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM a) q WHERE k = 1")
def cluster_center_member(s, d):
    return K.centre_members(_assigned(s, d), "vec_id", "label").withColumn("distance", F.round("distance", 6))


@query(_V + ", z AS (SELECT i, stddev_pop(x) AS s FROM v GROUP BY i) SELECT round(avg(s) * 1.5, 6) AS eps FROM z")
def eps_heuristic(s, d):
    return V.epsilon(vectors(s, d), 1.5).select(F.round("eps", 6).alias("eps"))


_EPS = 1.2


@query(
    _V + f""", g AS (SELECT a.vec_id AS a, b.vec_id AS b, sum((a.x - b.x) * (a.x - b.x)) AS d FROM v a JOIN v b USING (i) GROUP BY a.vec_id, b.vec_id)
    SELECT a AS vec_id FROM g WHERE d <= {_EPS} * {_EPS} GROUP BY a HAVING count(*) >= 3"""
)
def dbscan_core_points(s, d):
    pairs = K.neighbour_pairs(vectors(s, d), "vec_id", _EPS)
    return pairs.groupBy(F.col("a").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("vec_id")


@query(
    _V.replace("WITH", "WITH RECURSIVE", 1) + f""", g AS MATERIALIZED (SELECT a, b FROM (SELECT a.vec_id AS a, b.vec_id AS b, sum((a.x - b.x) * (a.x - b.x)) AS d FROM v a JOIN v b USING (i)
      GROUP BY a.vec_id, b.vec_id) q WHERE d <= {_EPS} * {_EPS}),
    c AS MATERIALIZED (SELECT a AS p FROM g GROUP BY a HAVING count(*) >= 3), l AS MATERIALIZED (SELECT a, b FROM g WHERE a IN (SELECT p FROM c) AND b IN (SELECT p FROM c)),
    w AS (SELECT p AS a, p AS b FROM c UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b), m AS (SELECT a AS p, min(b) AS cluster FROM w GROUP BY a),
    n AS (SELECT g.a, min(cluster) AS near FROM g JOIN m ON m.p = g.b GROUP BY g.a)
    SELECT vec_id, coalesce(cluster, near) AS cluster, cluster IS NOT NULL AS core FROM (SELECT DISTINCT vec_id FROM v) e LEFT JOIN m ON m.p = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
)
def dbscan_clusters(s, d):
    return K.dbscan(vectors(s, d), "vec_id", _EPS, 3)


def _lloyd(rounds: int, how: str) -> str:
    """SQL of so many Lloyd rounds from the classes' means or sums; empty clusters keep their centre."""
    sql = _V + f", c0 AS MATERIALIZED (SELECT label, i, {how}(x) AS x FROM v GROUP BY label, i)"
    for k in range(rounds + 1):
        sql += f""", d{k} AS MATERIALIZED (SELECT vec_id, label, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM
          (SELECT v.vec_id, c.label, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (i) GROUP BY v.vec_id, c.label) q) z WHERE k = 1)"""
        if k < rounds:
            sql += f""", c{k + 1} AS MATERIALIZED (SELECT c.label, c.i, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN
              (SELECT d.label, v.i, avg(v.x) AS x FROM v JOIN d{k} d USING (vec_id) GROUP BY d.label, v.i) m ON m.label = c.label AND m.i = c.i)"""
    return sql + f" SELECT vec_id, label, round(d, 6) AS distance FROM d{rounds}"


@query(_lloyd(4, "avg"))
def kmeans_clusters(s, d):
    v = vectors(s, d)
    return K.kmeans(v, K.centroids(v, "label"), "vec_id", "label", 4, tolerance=-1.0).withColumn("distance", F.round("distance", 6))


@query(_lloyd(2, "sum"))
def kmeans_seeded_by_sums(s, d):
    v = vectors(s, d)
    return K.kmeans(v, K.centroids(v, "label", "sum"), "vec_id", "label", 2, tolerance=-1.0).withColumn("distance", F.round("distance", 6))


@query(
    _V + """, s AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS label, vec_id FROM (SELECT DISTINCT vec_id FROM v) q QUALIFY row_number() OVER (ORDER BY vec_id) <= 6),
    c AS MATERIALIZED (SELECT s.label, v.i, v.x FROM s JOIN v USING (vec_id)),
    a AS MATERIALIZED (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM
      (SELECT v.vec_id, c.label, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c USING (i) GROUP BY v.vec_id, c.label) q) z WHERE k = 1),
    n AS (SELECT label, count(*) AS n FROM a GROUP BY label),
    m AS (SELECT c.label, c.i, coalesce((2 * c.x + t.x) / (2 + n.n), c.x) AS x FROM c LEFT JOIN n ON n.label = c.label LEFT JOIN
      (SELECT a.label, v.i, sum(v.x) AS x FROM v JOIN a USING (vec_id) GROUP BY a.label, v.i) t ON t.label = c.label AND t.i = c.i)
    SELECT m.label, 2 + coalesce(any_value(n.n), 0) AS n, round(sum(m.x * m.x), 6) AS square FROM m LEFT JOIN n ON n.label = m.label GROUP BY m.label"""
)
def minibatch_centres(s, d):
    """One batch on centres that stand for two vectors each so far."""
    v = vectors(s, d)
    order = Window.orderBy("vec_id")
    seeds = v.orderBy("vec_id").limit(6).select((F.row_number().over(order) - 1).alias("label"), "vec", F.lit(2).cast("bigint").alias("n"))
    _, moved = K.minibatch_step(v.drop("label"), seeds, "vec_id", "label")
    return moved.select("label", "n", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("square"))


@query(
    _C + """, z AS (SELECT vec_id, any_value(label) AS label, sum(x * x) AS q FROM v GROUP BY vec_id), n AS (SELECT label, count(*) AS n FROM z GROUP BY label),
    g AS (SELECT a.vec_id, a.label AS own, b.label AS other, b.vec_id AS w, sum((a.x - b.x) * (a.x - b.x)) AS d FROM v a JOIN v b USING (i) GROUP BY a.vec_id, a.label, b.label, b.vec_id),
    m AS (SELECT vec_id, own, other, sum(d) AS t FROM g GROUP BY vec_id, own, other),
    a AS (SELECT vec_id, t / greatest(n - 1, 1) AS a, n FROM m JOIN n ON n.label = m.own WHERE own = other),
    b AS (SELECT vec_id, min(t / n) AS b FROM m JOIN n ON n.label = m.other WHERE own <> other GROUP BY vec_id),
    s AS (SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM a JOIN b USING (vec_id)),
    e AS (SELECT v.vec_id, v.label, sqrt(sum((v.x - c.x) * (v.x - c.x))) AS e FROM v JOIN c ON c.label = v.label AND c.i = v.i GROUP BY v.vec_id, v.label),
    k AS (SELECT label, avg(e) AS k FROM e GROUP BY label),
    f AS (SELECT p.label AS a, q.label AS b, sqrt(sum((p.x - q.x) * (p.x - q.x))) AS f FROM c p JOIN c q ON p.i = q.i AND p.label <> q.label GROUP BY p.label, q.label),
    y AS (SELECT f.a, max((x.k + z.k) / f.f) AS y FROM f JOIN k x ON x.label = f.a JOIN k z ON z.label = f.b GROUP BY f.a)
    SELECT round(s.silhouette, 6) AS silhouette, round((SELECT avg(y) FROM y), 6) AS davies_bouldin FROM s"""
)
def silhouette_davies_bouldin(s, d):
    q = K.quality(vectors(s, d), "vec_id", "label")
    return q.select(F.round("silhouette", 6).alias("silhouette"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


_DEN = _A + """, r AS (SELECT label, avg(sqrt(d)) / ln(count(*) + 10) AS r FROM a GROUP BY label),
  b AS (SELECT quantile_cont(r, 0.3) AS lo, quantile_cont(r, 0.7) AS hi FROM r),
  k AS (SELECT label, greatest(least(r, hi), lo) AS k FROM r, b), w AS (SELECT label, k / (SELECT avg(k) FROM k) + 0.5 AS density FROM k)"""


@query(_DEN + " SELECT label, round(density, 6) AS density FROM w")
def cluster_density(s, d):
    return K.density(_assigned(s, d), "label").withColumn("density", F.round("density", 6))


def _ood(s, d):
    v = vectors(s, d)
    prototypes = K.centroids(v, "label").join(K.density(_assigned(s, d), "label"), "label")
    return K.prototype_scores(v, prototypes, "vec_id")


_OOD = _DEN + """, lc AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label), lv AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id),
  o AS (SELECT v.vec_id, c.label, sum(v.x * c.x) / (max(lv.n) * max(lc.n)) AS cs FROM v JOIN c USING (i) JOIN lc ON lc.label = c.label JOIN lv ON lv.vec_id = v.vec_id GROUP BY v.vec_id, c.label),
  p AS (SELECT vec_id, min(exp(cs / (density * 0.2))) AS score FROM o JOIN w USING (label) GROUP BY vec_id)"""


@query(_OOD + " SELECT vec_id, round(score, 6) AS score FROM p")
def ood_prototype_score(s, d):
    return _ood(s, d).withColumn("score", F.round("score", 6))


@query(
    _OOD + """, u AS (SELECT vec_id, score, lv.n FROM p JOIN lv USING (vec_id)), st AS (SELECT avg(score) AS ma, stddev_pop(score) AS sa, avg(n) AS mb, stddev_pop(n) AS sb FROM u)
    SELECT vec_id, round((score - ma) / sa + (n - mb) / sb, 6) AS z FROM u, st"""
)
def ood_zscore_sum(s, d):
    length = vectors(s, d).select("vec_id", V.norm(F.col("vec")).alias("n"))
    return K.z_sum(_ood(s, d).join(length, "vec_id"), ["score", "n"]).select("vec_id", F.round("z", 6).alias("z"))


@query(_V + " SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 6) AS mean, round(sum(x), 6) AS sum, round(max(x), 6) AS max FROM v GROUP BY label, i")
def readout_mean_sum_max(s, d):
    stats = V.element_stats(vectors(s, d), ["label"])
    return stats.select("label", "i", *[F.round(c, 6).alias(c) for c in ("mean", "sum", "max")])


@query(
    _C + """, g AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
    m AS (SELECT a, min(d) AS m FROM g GROUP BY a), k AS (SELECT m, row_number() OVER (ORDER BY m) AS k, count(*) OVER () AS n FROM m),
    l AS (SELECT m AS lim FROM k WHERE k = greatest(CAST(floor(0.3 * n) AS BIGINT), 1)) SELECT a, b FROM g, l WHERE a < b AND d <= lim + 1e-9"""
)
def prototype_merge_pairs(s, d):
    return K.prototype_merges(K.centroids(vectors(s, d), "label"), "label", 0.3)


_MAJ = _A + ", m AS (SELECT label, own, count(*) AS n FROM a GROUP BY label, own), j AS (SELECT label, own AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, own) AS k FROM m) q WHERE k = 1)"


def _members(s, d):
    own = vectors(s, d).select("vec_id", F.col("label").alias("own"))
    return _assigned(s, d).select("vec_id", F.col("label").alias("cluster")).join(own, "vec_id")


@query(_MAJ + " SELECT label AS cluster, predicted FROM j")
def majority_cluster_label(s, d):
    return K.majority_labels(_members(s, d), "cluster", "own")


@query(
    _MAJ + """, p AS (SELECT a.own AS actual, j.predicted FROM a JOIN j USING (label)), u AS (SELECT actual AS c, count(*) AS s, sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS t FROM p GROUP BY actual),
    w AS (SELECT predicted AS c, count(*) AS k FROM p GROUP BY predicted),
    x AS (SELECT s, t, CASE WHEN coalesce(k, 0) > 0 THEN t / k ELSE 0 END AS p, t / s AS r FROM u LEFT JOIN w USING (c))
    SELECT round(sum(t) / sum(s), 6) AS accuracy, round(sum(p * s) / sum(s), 6) AS "precision", round(sum(r * s) / sum(s), 6) AS recall,
      round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * s) / sum(s), 6) AS f1 FROM x"""
)
def weighted_prf(s, d):
    m = _members(s, d)
    pairs = m.join(K.majority_labels(m, "cluster", "own"), "cluster")
    scores = K.weighted_scores(pairs, "own", "predicted")
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query()
def denstream_fold(s, d):
    return K.denstream(vectors(s, d), ["label"], ["vec_id"], 1.5, 0.5, 3.0, 0.01)


@query()
def clustream_micro(s, d):
    return K.clustream(vectors(s, d), ["label"], ["vec_id"], 32, 400)


@query(_V + ", z AS (SELECT stddev_pop(x) AS a, stddev_pop(x * x) AS b FROM v) SELECT round(sqrt(a) / (sqrt(a) + sqrt(b)), 6) AS x, round(sqrt(b) / (sqrt(a) + sqrt(b)), 6) AS y FROM z")
def adaptive_loss_weights(s, d):
    v = vectors(s, d).select(F.explode("vec").alias("x")).withColumn("y", F.col("x") * F.col("x"))
    return K.adaptive_weights(v, ["x", "y"], 0.5).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """WITH x AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id % 2, label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY vec_id % 2, label) AS n FROM embeddings)
    SELECT vec_id, CASE WHEN k <= floor(n * CASE WHEN vec_id % 2 = 0 AND label = 1 THEN 0.9 ELSE 0.5 END) THEN 'train' ELSE 'test' END AS split FROM x"""
)
def dataset_bias_split(s, d):
    v = vectors(s, d).withColumn("shape", F.col("vec_id") % 2)
    return K.biased_split(v, "shape", "label", "vec_id", {(0, 1): 0.9}, 0.5).select("vec_id", "split")

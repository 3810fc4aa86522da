"""Named queries over the event, edge and log tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import correlate as C
from tracewright.operators import graph as G
from tracewright.operators import ordering as O
from tracewright.operators import triples as T
from tracewright.session import durable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_E = """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS src, event_type AS rel,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst, value FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def E(spark: SparkSession, d: str) -> DataFrame:
    return T.edge_view(table(spark, d, "events")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return E(spark, d).select(F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t"), "event_id", "us")


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# ---- triples -------------------------------------------------------------------------------------
@query(_E + " SELECT DISTINCT src, rel, dst FROM e")
def triple_distinct(s, d):
    return E(s, d).select("src", "rel", "dst").distinct()


@query(_E + " SELECT src, row_number() OVER (ORDER BY min(event_id), src) - 1 AS id FROM e GROUP BY src")
def entity_first_seen_ids(s, d):
    return T.first_seen_ids(E(s, d), "src", "event_id")


@query(
    _E + """, i AS (SELECT rel, row_number() OVER (ORDER BY min(event_id), rel) - 1 AS id FROM e GROUP BY rel)
    SELECT rel AS name, 2 * id AS id FROM i UNION ALL SELECT rel || '_inv', 2 * id + 1 FROM i"""
)
def relation_inverse_ids(s, d):
    return T.relation_ids(E(s, d), "rel", "event_id")


_W = _E + """, w AS (SELECT rel, dst, count(DISTINCT src) AS df, (SELECT count(DISTINCT src) FROM e) AS n FROM e GROUP BY rel, dst),
  x AS (SELECT rel, dst, df, df / n AS tf, log10((n + 1) / (df + 1)) AS idf FROM w)"""  # fmt: skip


@query(_W + " SELECT rel, dst, df, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf FROM x")
def triple_tfidf(s, d):
    w = T.term_frequency(E(s, d), "src", ["rel", "dst"])
    return w.select("rel", "dst", "df", r6("tf"), r6("idf"), r6("tfidf"))


@query(_E + ", t AS (SELECT DISTINCT rel, dst FROM e) SELECT rel, dst, round(1.0 / (SELECT count(*) FROM t), 9) AS weight FROM t")
def uniform_weight(s, d):
    return T.uniform_weight(E(s, d), ["rel", "dst"]).withColumn("weight", F.round("weight", 9))


@query(_W + " SELECT src, round(sum(tf * idf), 6) AS score FROM e JOIN x USING (rel, dst) GROUP BY src")
def graph_score_sum(s, d):
    e = E(s, d)
    scores = T.graph_scores(e, T.term_frequency(e, "src", ["rel", "dst"]), "src", ["rel", "dst"])
    return scores.select("src", r6("score"))


@query(
    _E + """, f AS (SELECT DISTINCT src AS h, rel AS r, dst AS t FROM e),
    a AS (SELECT r, avg(n) AS x FROM (SELECT r, h, count(*) AS n FROM f GROUP BY r, h) q GROUP BY r),
    b AS (SELECT r, avg(n) AS y FROM (SELECT r, t, count(*) AS n FROM f GROUP BY r, t) q GROUP BY r)
    SELECT r, round(x, 6) AS tails_per_head, round(y, 6) AS heads_per_tail,
      CASE WHEN y < 1.5 THEN '1' ELSE 'N' END || '-' || CASE WHEN x < 1.5 THEN '1' ELSE 'N' END AS kind FROM a JOIN b USING (r)"""
)
def relation_cardinality_class(s, d):
    return T.relation_cardinality(facts(s, d)).select("r", r6("tails_per_head"), r6("heads_per_tail"), "kind")


@query(_E + " SELECT DISTINCT rel AS r, 'head' AS side, src AS entity FROM e UNION SELECT DISTINCT rel, 'tail', dst FROM e")
def type_constraints(s, d):
    return T.type_constraints(facts(s, d))


@query(
    _E + """, f AS (SELECT DISTINCT src AS h, rel AS r, dst AS t FROM e) SELECT r, count(*) AS freq,
    round(count(*) / count(DISTINCT h), 6) AS left_mean, round(count(*) / count(DISTINCT t), 6) AS right_mean FROM f GROUP BY r"""
)
def bernoulli_stats(s, d):
    return T.bernoulli_stats(facts(s, d)).select("r", "freq", r6("left_mean"), r6("right_mean"))


@query(_E + ", x AS (SELECT src AS entity FROM e UNION ALL SELECT dst FROM e) SELECT entity, count(*) AS freq FROM x GROUP BY entity")
def entity_frequency(s, d):
    return T.entity_frequency(facts(s, d))


_IDS = _E + """, i AS (SELECT rel, row_number() OVER (ORDER BY min(event_id), rel) - 1 AS id FROM e GROUP BY rel),
  f AS (SELECT src AS h, 2 * id AS r, dst AS t FROM e JOIN i USING (rel))"""


def _id_facts(s, d):
    ids = T.relation_ids(E(s, d), "rel", "event_id")
    return facts(s, d).join(ids, F.col("r") == F.col("name")).select("h", F.col("id").alias("r"), "t")


@query(
    _IDS + """, b AS (SELECT h, r, t FROM f UNION ALL SELECT t, r + 1, h FROM f)
    SELECT h, r, count(DISTINCT t) AS n_answers FROM b GROUP BY h, r"""
)
def golden_answers_size(s, d):
    return T.golden_answers(_id_facts(s, d)).select("h", "r", F.size("answers").cast("bigint").alias("n_answers"))


@query(_IDS + " SELECT h, r, t FROM f UNION ALL SELECT t, r + 1, h FROM f")
def inverse_facts(s, d):
    return T.with_inverse(_id_facts(s, d))


@query(
    _IDS + """, b AS (SELECT h, r, t FROM f UNION ALL SELECT t, r + 1, h FROM f), n AS (SELECT h FROM b UNION SELECT t FROM b)
    SELECT h, r, t FROM b UNION ALL SELECT h, 99, h FROM n"""
)
def edge_index_with_loops(s, d):
    return T.edge_index(_id_facts(s, d), 99)


_S = _E + """, q AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS n FROM e),
  s AS (SELECT *, CAST(least(n // (SELECT count(*) // 4 FROM e), 3) AS INTEGER) AS snapshot FROM q)"""


@query(_S + " SELECT event_id, snapshot AS slice FROM s")
def time_slices(s, d):
    return O.time_slices(E(s, d).select("us", "event_id"), ["us", "event_id"]).select("event_id", "slice")


@query(
    _S + """, x AS (SELECT snapshot, src AS v FROM s UNION ALL SELECT snapshot, dst FROM s),
    ne AS (SELECT snapshot, count(*) AS c FROM (SELECT v, min(snapshot) AS snapshot FROM x GROUP BY v) z GROUP BY snapshot),
    nr AS (SELECT snapshot, count(*) AS c FROM (SELECT rel, min(snapshot) AS snapshot FROM s GROUP BY rel) z GROUP BY snapshot),
    o AS (SELECT snapshot, count(*) AS facts, count(DISTINCT rel) AS relations FROM s GROUP BY snapshot)
    SELECT o.snapshot, facts, relations, coalesce(ne.c, 0) AS new_entities, coalesce(nr.c, 0) AS new_relations,
      CAST(sum(coalesce(ne.c, 0)) OVER (ORDER BY o.snapshot) AS BIGINT) AS num_ent,
      CAST(sum(coalesce(nr.c, 0)) OVER (ORDER BY o.snapshot) AS BIGINT) AS num_rel,
      CAST(sum(facts) OVER (ORDER BY o.snapshot) AS BIGINT) AS facts_so_far
    FROM o LEFT JOIN ne ON ne.snapshot = o.snapshot LEFT JOIN nr ON nr.snapshot = o.snapshot"""
)
def snapshot_cumulative_entities(s, d):
    sliced = O.time_slices(facts(s, d), ["us", "event_id"], out="snapshot")
    return T.snapshot_growth(sliced)


@query(
    _E + """, f AS (SELECT DISTINCT src AS h, rel AS r, dst AS t FROM e),
    ent AS (SELECT name, row_number() OVER (ORDER BY min(event_id), name) - 1 AS i FROM (SELECT src AS name, event_id FROM e UNION ALL SELECT dst, event_id FROM e) q GROUP BY name),
    n AS (SELECT count(*) AS n FROM ent),
    x AS (SELECT h, r, t, d.v AS draw, k.v AS try, (h * 31 + t * 17 + d.v * 7 + k.v * 101) % n AS i
      FROM f, n, (SELECT unnest([1, 2]) AS v) d, (SELECT unnest([0, 1, 2, 3]) AS v) k),
    y AS (SELECT x.*, CASE WHEN draw % 2 = 0 THEN name ELSE h END AS nh, CASE WHEN draw % 2 = 0 THEN t ELSE name END AS nt FROM x JOIN ent USING (i)),
    z AS (SELECT y.*, row_number() OVER (PARTITION BY y.h, y.r, y.t, y.draw ORDER BY y.try) AS k FROM y ANTI JOIN f ON f.h = y.nh AND f.r = y.r AND f.t = y.nt),
    found AS (SELECT h, r, t, draw, nh, nt FROM z WHERE k = 1),
    lost AS (SELECT h, r, t, draw, i AS start FROM y WHERE try = 3 AND NOT EXISTS (SELECT 1 FROM found g WHERE g.h = y.h AND g.r = y.r AND g.t = y.t AND g.draw = y.draw)),
    tried AS (SELECT lost.*, (ent.i - start + n) % n AS far, CASE WHEN draw % 2 = 0 THEN name ELSE h END AS nh, CASE WHEN draw % 2 = 0 THEN t ELSE name END AS nt FROM lost, ent, n),
    near AS (SELECT v.*, row_number() OVER (PARTITION BY v.h, v.r, v.t, v.draw ORDER BY far) AS k FROM tried v ANTI JOIN f ON f.h = v.nh AND f.r = v.r AND f.t = v.nt)
    SELECT * FROM found UNION ALL SELECT h, r, t, draw, nh, nt FROM near WHERE k = 1"""
)
def negatives_filtered(s, d):
    f = facts(s, d)
    ends = f.select(F.col("h").alias("name"), "event_id").union(f.select("t", "event_id"))
    entities = durable(T.first_seen_ids(ends, "name", "event_id", "index").select(F.col("name").alias("id"), "index"))
    pick = F.pmod(F.col("h") * 31 + F.col("t") * 17 + F.col("draw") * 7 + F.col("try") * 101, F.lit(entities.count()))
    return T.corrupt(f.select("h", "r", "t").distinct(), entities, 2, pick)


@query(
    _E + """, f AS (SELECT DISTINCT src AS h, rel AS r, dst AS t FROM e), k AS (SELECT DISTINCT r, t FROM f), p AS (SELECT DISTINCT h, r FROM f),
    u AS (SELECT p.h, p.r, k.t FROM p JOIN k USING (r) ANTI JOIN f ON f.h = p.h AND f.r = p.r AND f.t = k.t),
    l AS (SELECT h, r, list(t ORDER BY t) AS free FROM u GROUP BY h, r),
    c AS (SELECT f.h, f.r, f.t, d.v AS draw, free, list_concat(list_filter(free, lambda x: x > f.t), list_filter(free, lambda x: x < f.t)) AS following
      FROM f JOIN l USING (h, r), (SELECT unnest([1, 2]) AS v) d)
    SELECT h, r, t, draw, following[(draw - 1) % len(free) + 1] AS nt FROM c"""
)
def negatives_type_constrained(s, d):
    return T.constrained_tails(facts(s, d), 2)


# ---- order -----------------------------------------------------------------------------------------
@query(_E + " SELECT event_id, row_number() OVER (ORDER BY us // 1000000, rel, event_id) - 1 AS label FROM e")
def dense_label_counter(s, d):
    e = E(s, d).withColumn("tick", F.floor(F.col("us") / 1_000_000))
    return O.label_numbers(e.select("tick", "rel", "event_id"), "tick", ["rel", "event_id"]).select("event_id", "label")


@query(_E + " SELECT event_id, round(sum(value) OVER (ORDER BY event_id) - (SELECT sum(value) FROM e WHERE event_id <= 50) + 1000, 4) AS \"at\" FROM e")
def delta_to_absolute_ts(s, d):
    e = E(s, d).select("event_id", "value")
    return O.absolute_times(e, "value", ["event_id"], F.col("event_id") == 50, 1000.0).select("event_id", F.round("at", 4).alias("at"))


@query(
    _E + """, x AS (SELECT *, lag(rel) OVER w AS p FROM e WINDOW w AS (PARTITION BY src ORDER BY us, event_id))
    SELECT event_id, src, rel FROM x WHERE p IS NULL OR p <> rel"""
)
def consecutive_dedup(s, d):
    return O.drop_repeats(E(s, d), ["src"], ["us", "event_id"], ["rel"]).select("event_id", "src", "rel")


@query(
    _E + """, x AS (SELECT *, CASE WHEN lag(rel) OVER w IS NULL OR lag(rel) OVER w <> rel THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY src ORDER BY us, event_id)),
    y AS (SELECT *, sum(b) OVER (PARTITION BY src ORDER BY us, event_id) AS island FROM x),
    z AS (SELECT src, island, event_id, value, count(*) OVER (PARTITION BY src, island) AS n_rows,
      row_number() OVER (PARTITION BY src, island ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, us, event_id) AS k FROM y)
    SELECT src, event_id, n_rows, value FROM z WHERE k = 1"""
)
def island_collapse(s, d):
    done = O.island_collapse(E(s, d), ["src"], ["us", "event_id"], ["rel"], F.col("value") > 50, ["event_id", "value"])
    return done.select("src", "event_id", "n_rows", "value")


@query(
    _E + """ SELECT event_id, last_value(CASE WHEN rel = 'click' THEN dst END IGNORE NULLS)
    OVER (PARTITION BY src ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS port FROM e"""
)
def carry_forward(s, d):
    value = F.when(F.col("rel") == "click", F.col("dst"))
    return O.carry_forward(E(s, d), ["src"], ["us", "event_id"], value, "port").select("event_id", "port")


@query(
    _E + """, l AS (SELECT src, list(dst ORDER BY us, event_id) AS labels FROM e WHERE rel = 'signup' GROUP BY src),
    h AS (SELECT event_id, src, sum(CASE WHEN rel = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY us, event_id) AS n FROM e)
    SELECT event_id, CASE WHEN n > 0 THEN labels[CAST(n AS BIGINT)] END AS override FROM h LEFT JOIN l USING (src)"""
)
def boundary_queue_relabel(s, d):
    e = E(s, d)
    own = F.array_sort(F.collect_list(F.struct("us", "event_id", "dst")))
    queues = e.filter("rel = 'signup'").groupBy("src").agg(F.transform(own, lambda x: x["dst"]).alias("labels"))
    return O.boundary_relabel(e, queues, "src", ["us", "event_id"], F.col("rel") == "error").select("event_id", "override")


# ---- joins -----------------------------------------------------------------------------------------
def _side(s, d, rel):
    return E(s, d).filter(F.col("rel") == rel)


@query(
    _E + """, x AS (SELECT a.event_id, a.src, b.event_id AS app_id, ln(1 + 1 / (abs(a.us - b.us) / 1e6 + 1e-9)) AS s
      FROM e a JOIN e b ON a.src = b.src AND a.rel = 'click' AND b.rel = 'purchase' AND abs(a.us - b.us) <= 3600000000),
    y AS (SELECT *, row_number() OVER (PARTITION BY src, event_id ORDER BY s DESC, app_id) AS k FROM x)
    SELECT src, event_id, app_id, round(s, 6) AS score FROM y WHERE k = 1"""
)
def best_score_interval_join(s, d):
    events = _side(s, d, "click").select("src", "event_id", "us")
    apps = _side(s, d, "purchase").select("src", F.col("event_id").alias("app_id"), F.col("us").alias("app_us"))
    score = C.time_score(F.col("us") / 1e6, F.col("app_us") / 1e6)
    best = C.best_score_join(events, apps, ["src"], "event_id", "us", "app_id", "app_us", 3_600_000_000, score)
    return best.select("src", "event_id", "app_id", r6("score"))


@query(
    _E + """ SELECT a.src, a.dst % 10 AS k, a.event_id, (SELECT b.event_id FROM e b WHERE b.rel = 'view' AND b.src = a.src AND b.dst % 10 = a.dst % 10
      AND b.us >= a.us ORDER BY b.us, b.event_id LIMIT 1) AS next_id FROM e a WHERE a.rel = 'click'"""
)
def asof_forward_text_match(s, d):
    left = _side(s, d, "click").select("src", (F.col("dst") % 10).alias("k"), "event_id", "us")
    right = _side(s, d, "view").select("src", (F.col("dst") % 10).alias("k"), F.col("event_id").alias("next_id"), "us")
    return C.asof_forward(left, right, ["src", "k"], "event_id", "us", "next_id", "us")


def _disjunctive(s, d, last):
    nets = _side(s, d, "click").select("event_id", "src", "dst")
    apps = _side(s, d, "purchase").select(F.col("event_id").alias("app_id"), F.col("src").alias("host"), F.col("dst").alias("payload"))
    return C.any_match(nets, apps, [(["src"], ["host"]), (["dst"], ["host"]), (["dst"], ["payload"])], "event_id", "app_id", last)


_D = _E + """ SELECT a.event_id, {f}(b.event_id) AS app_id FROM e a JOIN e b ON a.rel = 'click' AND b.rel = 'purchase'
  AND (a.src = b.src OR a.dst = b.src OR a.dst = b.dst) GROUP BY a.event_id"""


@query(_D.format(f="min"))
def first_match_wins(s, d):
    return _disjunctive(s, d, False)


@query(_D.format(f="max"))
def last_match_wins(s, d):
    return _disjunctive(s, d, True)


@query(
    _E + """, x AS (SELECT src, event_id, row_number() OVER (PARTITION BY src ORDER BY us, event_id) AS rank_first,
      row_number() OVER (PARTITION BY src ORDER BY us DESC, event_id DESC) AS rank_last FROM e) SELECT * FROM x WHERE rank_first <= 3 OR rank_last <= 4"""
)
def topk_per_group_connect(s, d):
    return C.first_and_last(E(s, d), ["src"], ["us", "event_id"], 3, 4).select("src", "event_id", "rank_first", "rank_last")


@query(
    _E + """, a AS (SELECT src, event_id, row_number() OVER (PARTITION BY src ORDER BY us, event_id) AS rank FROM e WHERE rel = 'click'),
    b AS (SELECT src, event_id, row_number() OVER (PARTITION BY src ORDER BY us, event_id) AS rank FROM e WHERE rel = 'purchase')
    SELECT src, rank, a.event_id AS click_id, b.event_id AS purchase_id FROM a JOIN b USING (src, rank)"""
)
def rank_to_rank_join(s, d):
    a = _side(s, d, "click").select("src", F.col("event_id").alias("click_id"), "us")
    b = _side(s, d, "purchase").select("src", F.col("event_id").alias("purchase_id"), F.col("us").alias("bus"))
    return C.rank_to_rank(a, b, ["src"], ["us", "click_id"], ["bus", "purchase_id"]).select("src", "rank", "click_id", "purchase_id")


@query(
    """WITH n AS (SELECT DISTINCT net_id, s_port, d_port, httpdata FROM netlogs), p AS (SELECT s_port AS port, min(net_id) AS label FROM n WHERE httpdata IS NOT NULL GROUP BY s_port)
    SELECT net_id, coalesce(a.label, b.label) AS label FROM n LEFT JOIN p a ON a.port = n.s_port LEFT JOIN p b ON b.port = n.d_port"""
)
def offline_port_label(s, d):
    nets = table(s, d, "netlogs").select("net_id", "s_port", "d_port", "httpdata").distinct()
    return C.first_port_label(nets, "net_id", "s_port", "d_port", F.col("httpdata").isNotNull()).select("net_id", "label")


@query(
    _E + """, h AS (SELECT src, v, count(*) AS n FROM (SELECT src, dst % 10 AS v FROM e WHERE rel = 'view') q GROUP BY src, v),
    w AS (SELECT src, sum(n) AS a FROM h GROUP BY src)
    SELECT event_id, round(((CASE WHEN s.n IS NULL THEN 0 ELSE 1 END) + (CASE WHEN o.n IS NULL THEN 0 ELSE 1 END)) / 2
      * exp((coalesce(s.n, 0) + coalesce(o.n, 0)) / a), 6) AS relevance
    FROM e LEFT JOIN h s ON s.src = e.src AND s.v = e.dst % 10 LEFT JOIN h o ON o.src = e.src AND o.v = (e.dst + 3) % 10
    LEFT JOIN w ON w.src = e.src WHERE rel = 'click'"""
)
def key_histogram_relevance(s, d):
    e = E(s, d)
    units = e.filter("rel = 'view'").select("src", (F.col("dst") % 10).alias("v"))
    asked = e.filter("rel = 'click'").select("event_id", "src", (F.col("dst") % 10).alias("subject"), ((F.col("dst") + 3) % 10).alias("object"))
    return C.key_relevance(asked, units, "src", "v", "subject", "object").select("event_id", r6("relevance"))


@query(
    """WITH n AS (SELECT DISTINCT net_id, s_ip, s_port, d_ip, d_port, httpdata FROM netlogs),
    x AS (SELECT *, row_number() OVER (PARTITION BY s_ip, s_port, d_ip, d_port ORDER BY net_id) AS k FROM n)
    SELECT net_id FROM x WHERE k = 1 OR httpdata IS NOT NULL"""
)
def net_4tuple_dedup(s, d):
    nets = table(s, d, "netlogs").select("net_id", "s_ip", "s_port", "d_ip", "d_port", "httpdata").distinct()
    by = ["s_ip", "s_port", "d_ip", "d_port"]
    # The first of a tuple is an aggregate, so a hot tuple is combined before the shuffle.
    first = nets.groupBy(*by).agg(F.min("net_id").alias("net_id")).select("net_id")
    return first.union(nets.filter("httpdata is not null").select("net_id")).distinct()


# ---- aggregates ------------------------------------------------------------------------------------
_D1 = "d AS (SELECT DISTINCT edge_key, graph_id, subject_name, object_name, object_type, log_type, epoch_us(event_ts) AS us, data_source, unit_label FROM edges)"


def _edges(s, d):
    """Edges once each: deliveries differ in nothing that is selected here."""
    return table(s, d, "edges").select(
        "edge_key", "graph_id", "subject_name", "object_name", "object_type", "log_type",
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"), "data_source", "unit_label",
    ).distinct()


@query(f"WITH {_D1} SELECT unit_label, count(*) AS n, min(edge_key) AS first_key, max(edge_key) AS last_key FROM d WHERE unit_label IS NOT NULL GROUP BY unit_label")
def label_index(s, d):
    n = F.count(F.lit(1)).alias("n")
    return _edges(s, d).filter("unit_label is not null").groupBy("unit_label").agg(n, F.min("edge_key").alias("first_key"), F.max("edge_key").alias("last_key"))


@query(f"WITH {_D1} SELECT unit_label, min(us) AS first_us, max(us) AS last_us FROM d WHERE unit_label IS NOT NULL GROUP BY unit_label")
def label_time_range(s, d):
    return _edges(s, d).filter("unit_label is not null").groupBy("unit_label").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


_NOISE = "(object_name IS NULL OR object_name IN ('', '/', '.') OR contains(object_name, '/pub/') OR contains(object_name, '.gif'))"


@query(f"WITH {_D1} SELECT edge_key FROM d WHERE NOT {_NOISE}")
def noise_edge_antijoin(s, d):
    return _edges(s, d).filter(~G.is_noise(F.col("object_name"), ["/pub/", ".gif"])).select("edge_key")


@query(f"WITH {_D1} SELECT DISTINCT graph_id, object_name FROM d WHERE {_NOISE}")
def noise_node_filter(s, d):
    return _edges(s, d).filter(G.is_noise(F.col("object_name"), ["/pub/", ".gif"])).select("graph_id", "object_name").distinct()


@query(
    f"""WITH {_D1}, b AS (SELECT data_source, count(*) AS edges_before FROM d GROUP BY data_source),
    a AS (SELECT data_source, count(*) AS edges_after FROM d WHERE NOT {_NOISE} GROUP BY data_source)
    SELECT data_source, edges_before, coalesce(edges_after, 0) AS edges_after, round(1 - coalesce(edges_after, 0) / edges_before, 6) AS removed_share
    FROM b LEFT JOIN a USING (data_source)"""
)
def compression_report(s, d):
    before = _edges(s, d)
    after = before.filter(~G.is_noise(F.col("object_name"), ["/pub/", ".gif"]))
    return G.reduction_report(before, after, "data_source").withColumn("removed_share", F.round("removed_share", 6))


@query(f"""WITH {_D1}, n AS (SELECT graph_id, subject_name AS name FROM d UNION SELECT graph_id, object_name FROM d)
    SELECT graph_id, name, row_number() OVER (PARTITION BY graph_id ORDER BY name) - 1 AS node_id FROM n WHERE name IS NOT NULL""")
def relabel_nodes(s, d):
    return G.node_ids(_edges(s, d).withColumnsRenamed({"subject_name": "src", "object_name": "dst"}), "graph_id")


@query(f"WITH {_D1} SELECT graph_id, subject_name AS src, count(*) AS degree FROM d GROUP BY graph_id, subject_name HAVING count(*) > 20")
def degree_cap(s, d):
    return G.exploding_nodes(_edges(s, d).withColumnRenamed("subject_name", "src"), ["graph_id"], 20)


# ---- graphs ----------------------------------------------------------------------------------------
_G = _E + ", g AS (SELECT event_id, src % 7 AS graph, src % 40 AS src, dst % 40 AS dst, rel AS relation, us // 1000 AS start, us // 1000 + 1800000 AS stop FROM e)"


def _graph_edges(s, d):
    ms = F.floor(F.col("us") / 1000)
    return E(s, d).select(
        "event_id", (F.col("src") % 7).alias("graph"), (F.col("src") % 40).alias("src"), (F.col("dst") % 40).alias("dst"),
        F.col("rel").alias("relation"), ms.alias("start"), (ms + 1_800_000).alias("end"),
    )


@query(
    _G + """, w AS (SELECT *, lag(start) OVER x AS ps, lag(stop) OVER x AS pe FROM g WINDOW x AS (PARTITION BY graph, src, dst, relation ORDER BY start, stop, event_id)),
    k AS (SELECT w.*, CASE WHEN ps IS NULL OR EXISTS (SELECT 1 FROM g o WHERE o.graph = w.graph AND o.src = w.dst AND o.stop >= w.ps AND o.start <= w.start)
      OR EXISTS (SELECT 1 FROM g i WHERE i.graph = w.graph AND i.dst = w.src AND i.stop >= w.pe AND i.start <= w.stop) THEN 1 ELSE 0 END AS kept FROM w),
    l AS (SELECT *, sum(kept) OVER (PARTITION BY graph, src, dst, relation ORDER BY start, stop, event_id) AS island FROM k)
    SELECT graph, src, dst, relation, arg_min(event_id, start) AS event_id, min(start) AS start, max(stop) AS stop, count(*) AS n_edges
    FROM l GROUP BY graph, src, dst, relation, island"""
)
def cpr_merge(s, d):
    merged = G.cpr_merge(_graph_edges(s, d), ["graph"], "event_id")
    return merged.select("graph", "src", "dst", "relation", "event_id", "start", F.col("end").alias("stop"), "n_edges")


@query(
    """WITH d AS (SELECT edge_key, graph_id, subject_name, us, v FROM (SELECT edge_key, graph_id, subject_name, epoch_us(event_ts) AS us,
      list_sort(list_distinct(map_values(log_data))) AS v, row_number() OVER (PARTITION BY edge_key ORDER BY ingested_at) AS k FROM edges WHERE log_data IS NOT NULL) q WHERE k = 1),
    x AS (SELECT edge_key, v, lag(v) OVER (PARTITION BY graph_id, subject_name ORDER BY us, edge_key) AS p FROM d)
    SELECT edge_key, round(CASE WHEN len(list_distinct(list_concat(v, p))) = 0 THEN 1.0 ELSE len(list_intersect(v, p)) / len(list_distinct(list_concat(v, p))) END, 6) AS similarity FROM x WHERE p IS NOT NULL"""
)
def jaccard_pairs(s, d):
    edges = table(s, d, "edges").filter("log_data is not null").select("edge_key", "graph_id", "subject_name", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"), "log_data").dropDuplicates(["edge_key"])
    # Nulls come first in both orders of the comparison.
    done = G.jaccard_to_previous(edges.withColumn("has", F.col("us").isNull().cast("int")), ["graph_id", "subject_name"], ["has", "us", "edge_key"], "log_data")
    return done.filter("similarity is not null").select("edge_key", r6("similarity"))


@query(
    """WITH RECURSIVE e AS (SELECT edge_key, graph_id, coalesce(subject_name, '') AS s, coalesce(object_name, '') AS o, coalesce(log_type, '') AS r, epoch_us(event_ts) // 1000 AS start,
      coalesce(list_distinct(list_filter(map_values(log_data), lambda x: x IS NOT NULL)), []) AS v FROM edges WHERE event_ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_key ORDER BY ingested_at) = 1),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id, s, o, r ORDER BY start, edge_key) AS k FROM e),
    f AS (SELECT graph_id, s, o, r, k, edge_key, start AS head, v AS held, true AS kept FROM n WHERE k = 1
      UNION ALL SELECT n.graph_id, n.s, n.o, n.r, n.k, n.edge_key, CASE WHEN x.new THEN n.start ELSE head END, CASE WHEN x.new THEN n.v ELSE held END, x.new
      FROM f JOIN n ON n.graph_id IS NOT DISTINCT FROM f.graph_id AND n.s = f.s AND n.o = f.o AND n.r = f.r AND n.k = f.k + 1,
        LATERAL (SELECT n.start - f.head > 10 OR CASE WHEN len(list_distinct(list_concat(n.v, f.held))) = 0 THEN 1.0 ELSE len(list_intersect(n.v, f.held)) / len(list_distinct(list_concat(n.v, f.held))) END <= 0.95 AS new) x)
    SELECT edge_key FROM f WHERE kept"""
)
def head_anchored_gap(s, d):
    edges = table(s, d, "edges").filter("event_ts is not null").dropDuplicates(["edge_key"])
    sets = edges.withColumn("values", F.coalesce(G.value_set(F.col("log_data")), F.array().cast("array<string>")))
    timed = sets.withColumn("start", F.floor(F.unix_micros(F.col("event_ts").cast("timestamp")) / 1000))
    keys = ["graph_id", "subject_name", "object_name", "log_type"]
    return G.head_anchored(timed.select(*[F.coalesce(k, F.lit("")).alias(k) if k != "graph_id" else k for k in keys], "edge_key", "start", "values"), keys, "edge_key")


@query(
    _E + """
    , o AS (SELECT rel, src AS start, dst AS node, min(us) AS t0 FROM e GROUP BY rel, src, dst),
    t AS (SELECT o.rel, o.start, b.dst AS node, min(b.us) AS t0 FROM o JOIN e b ON b.rel = o.rel AND b.src = o.node AND b.us > o.t0 GROUP BY o.rel, o.start, b.dst),
    u AS (SELECT rel, start, node, t0, 1 AS hop FROM o UNION ALL SELECT rel, start, node, t0, 2 FROM t)
    SELECT rel, start, node, min(t0) AS "at", CAST(min(hop) AS INTEGER) AS hop FROM u GROUP BY rel, start, node"""
)
def temporal_reachability_2hop(s, d):
    edges = E(s, d).select("rel", "src", "dst", F.col("us").alias("at"))
    starts = edges.select("rel", F.col("src").alias("start")).distinct()
    return G.reach_in_time(edges, starts, 2, ["rel"]).select("rel", "start", "node", "at", "hop")


_WCC = """WITH RECURSIVE d AS (SELECT DISTINCT edge_key, graph_id, subject_name, object_name FROM edges),
  p AS MATERIALIZED (SELECT DISTINCT graph_id, 's:' || subject_name AS src, 'o:' || object_name AS dst FROM d WHERE subject_name IS NOT NULL AND object_name IS NOT NULL),
  l AS MATERIALIZED (SELECT graph_id, src AS a, dst AS b FROM p UNION SELECT graph_id, dst, src FROM p),
  w AS (SELECT graph_id, a AS node, a AS seen FROM l UNION SELECT w.graph_id, w.node, l.b FROM w JOIN l ON l.graph_id = w.graph_id AND l.a = w.seen),
  c AS MATERIALIZED (SELECT graph_id, node, min(seen) AS component FROM w GROUP BY graph_id, node)"""


@query(_WCC + " SELECT * FROM c")
def wcc_labels(s, d):
    edges = _edges(s, d).select("graph_id", F.concat(F.lit("s:"), "subject_name").alias("src"), F.concat(F.lit("o:"), "object_name").alias("dst"))
    return G.components(edges.filter("src is not null and dst is not null"), ["graph_id"])


@query(
    _E + """, p AS (SELECT DISTINCT us // 86400000000 AS day, src AS graph, rel, dst % 4 AS dst FROM e)
    SELECT DISTINCT g.day, g.graph FROM (SELECT DISTINCT day, graph FROM p) g JOIN (SELECT DISTINCT day, graph FROM p) f ON f.day = g.day AND f.graph < g.graph
    WHERE NOT EXISTS (SELECT 1 FROM p a WHERE a.day = g.day AND a.graph = g.graph
      AND NOT EXISTS (SELECT 1 FROM p b WHERE b.day = f.day AND b.graph = f.graph AND b.rel = a.rel AND b.dst = a.dst))"""
)
def subset_graph_prune(s, d):
    e = E(s, d).select(F.floor(F.col("us") / 86_400_000_000).alias("day"), F.col("src").alias("graph"), F.col("rel").alias("src"), (F.col("dst") % 4).alias("dst"))
    return G.subset_graphs(e, "graph", ["day"]).select("day", "graph")


@query(
    f"""WITH {_D1}, w AS (SELECT graph_id, subject_name AS src, object_name AS dst, unit_label AS label, min(us) AS lo, max(us) AS hi FROM d
      WHERE unit_label IS NOT NULL GROUP BY ALL),
    c AS (SELECT d.edge_key, min(w.label) AS label FROM d JOIN w ON w.graph_id = d.graph_id AND w.src = d.subject_name AND w.dst = d.object_name
      AND d.us BETWEEN w.lo AND w.hi WHERE d.unit_label IS NULL GROUP BY d.edge_key)
    SELECT d.edge_key, coalesce(d.unit_label, c.label) AS label FROM d LEFT JOIN c ON c.edge_key = d.edge_key"""
)
def parallel_edge_claims(s, d):
    edges = _edges(s, d).withColumnsRenamed({"subject_name": "src", "object_name": "dst", "unit_label": "label", "us": "start"})
    return G.claim_parallel(edges, ["graph_id"], "edge_key").select("edge_key", "label")


@query(
    _WCC + """, r AS (SELECT graph_id, component, min(node) AS node FROM c GROUP BY graph_id, component), f AS (SELECT graph_id, min(component) AS first FROM r GROUP BY graph_id)
    SELECT r.graph_id, r.node AS src, z.node AS dst FROM r JOIN f USING (graph_id) JOIN r z ON z.graph_id = r.graph_id AND z.component = f.first WHERE r.component <> f.first"""
)
def component_bridges(s, d):
    return G.component_bridges(wcc_labels(s, d), ["graph_id"])


@query(
    _E + """ SELECT a.event_id, b.event_id AS app_id FROM e a JOIN e b ON a.src = b.src AND a.rel = 'click' AND b.rel = 'view'
    AND abs(a.us - b.us) <= 3600000000"""
)
def window_correlate(s, d):
    from tracewright.streaming.windows import correlate_streams

    nets = _side(s, d, "click").select("event_id", "src", F.col("ts").cast("timestamp").alias("net_at"))
    apps = _side(s, d, "view").select(F.col("event_id").alias("app_id"), "src", F.col("ts").cast("timestamp").alias("app_at"))
    return correlate_streams(nets, apps, ["src"], "net_at", "app_at", "1 hour").select("event_id", "app_id")


@query(
    _E + """, x AS (SELECT src, us, CASE WHEN us - lag(us) OVER w < 7200000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY src ORDER BY us)),
    y AS (SELECT src, us, sum(b) OVER (PARTITION BY src ORDER BY us) AS g FROM x)
    SELECT src, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM y GROUP BY src, g"""
)
def session_gaps(s, d):
    from tracewright.streaming.windows import session_groups

    e = E(s, d).select("src", F.col("ts").cast("timestamp").alias("at"))
    done = session_groups(e, ["src"], "at", "2 hours")
    return done.select("src", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


# ---- text ------------------------------------------------------------------------------------------
@query(
    """SELECT app_id, min(CASE WHEN url LIKE '%?%' THEN split_part(url, '?', 1) ELSE url END) AS path,
    min(regexp_extract(CASE WHEN url LIKE '%?%' THEN split_part(url, '?', 1) ELSE url END, '\\.([A-Za-z0-9]+)$', 1)) AS suffix,
    min(CASE WHEN url LIKE '%?%' THEN len(url) - len(replace(url, '&', '')) + 1 ELSE 0 END) AS n_parameters FROM apachelogs GROUP BY app_id"""
)
def url_parse(s, d):
    from tracewright.functions.parsers import url_parts

    logs = table(s, d, "apachelogs").select("app_id", "url")
    parts = logs.select("app_id", *url_parts(F.col("url")))
    return parts.groupBy("app_id").agg(*[F.min(c).alias(c) for c in ("path", "suffix", "n_parameters")])


@query(
    """SELECT event_id, 'k' AS key, regexp_extract(props, '"k": *([0-9]+)', 1) AS value FROM events
    UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, 'msg', 'seen by ' || user_id FROM events"""
)
def kv_tokenize(s, d):
    from tracewright.functions.parsers import key_values

    line = F.concat(F.lit("k="), F.regexp_extract("props", r'"k": *([0-9]+)', 1), F.lit(' type="'), F.col("event_type"), F.lit('" msg=seen by '), F.col("user_id").cast("string"))
    return table(s, d, "events").select("event_id", F.explode(key_values(line)).alias("key", "value"))

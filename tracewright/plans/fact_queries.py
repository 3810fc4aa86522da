"""Named queries over facts: corrupted facts, dictionaries, files of facts and vectors; with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import triples as T
from tracewright.session import durable, shared_folder, table
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


_E = """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS h, event_type AS r, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS t, value FROM events),
  f AS (SELECT DISTINCT h, r, t FROM e)"""


def _events(s: SparkSession, d: str) -> DataFrame:
    return T.edge_view(table(s, d, "events")).select(
        "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t"), "value"
    )


def _facts(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select("h", "r", "t").distinct()


def _path(s: SparkSession) -> str:
    return f"{shared_folder(s)}/query-{uuid4().hex}"


# ---- corrupted facts -------------------------------------------------------------------------------
@query(
    _E + """, ent AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT h AS id FROM f UNION SELECT t FROM f) q), n AS (SELECT count(*) AS n FROM ent),
    st AS (SELECT r, count(*) / count(DISTINCT h) AS l, count(*) / count(DISTINCT t) AS g FROM f GROUP BY r),
    x AS (SELECT f.*, d.v AS draw, k.v AS try, (f.h * 13 + f.t * 29 + d.v * 5 + k.v * 77) % n AS i, ((f.h * 7 + f.t * 3 + d.v * 11) % 100) / 100 < g / (l + g) AS head
      FROM f JOIN st USING (r), n, (SELECT unnest([1, 2]) AS v) d, (SELECT unnest([0, 1, 2, 3]) AS v) k),
    y AS (SELECT x.*, CASE WHEN head THEN id ELSE h END AS nh, CASE WHEN head THEN t ELSE id END AS nt FROM x JOIN ent USING (i)),
    z AS (SELECT y.*, row_number() OVER (PARTITION BY y.h, y.r, y.t, y.draw ORDER BY y.try) AS k FROM y ANTI JOIN f ON f.h = y.nh AND f.r = y.r AND f.t = y.nt),
    found AS (SELECT h, r, t, draw, nh, nt FROM z WHERE k = 1),
    lost AS (SELECT h, r, t, draw, head, i AS start FROM y WHERE try = 3 AND NOT EXISTS (SELECT 1 FROM found g WHERE g.h = y.h AND g.r = y.r AND g.t = y.t AND g.draw = y.draw)),
    tried AS (SELECT lost.*, (ent.i - start + n) % n AS far, CASE WHEN head THEN id ELSE h END AS nh, CASE WHEN head THEN t ELSE id END AS nt FROM lost, ent, n),
    near AS (SELECT v.*, row_number() OVER (PARTITION BY v.h, v.r, v.t, v.draw ORDER BY far) AS k FROM tried v ANTI JOIN f ON f.h = v.nh AND f.r = v.r AND f.t = v.nt)
    SELECT * FROM found UNION ALL SELECT h, r, t, draw, nh, nt FROM near WHERE k = 1"""
)
def negatives_bernoulli(s, d):
    """The side that is replaced goes by the relation's mean tails and heads."""
    f = _facts(s, d)
    ends = f.select(F.col("h").alias("id")).union(f.select("t")).distinct()
    entities = durable(T.first_seen_ids(ends, "id", "id", "index"))
    pick = F.pmod(F.col("h") * 13 + F.col("t") * 29 + F.col("draw") * 5 + F.col("try") * 77, F.lit(entities.count()))
    u = F.pmod(F.col("h") * 7 + F.col("t") * 3 + F.col("draw") * 11, F.lit(100)) / 100
    return T.corrupt(f, entities, 2, pick, shares=T.head_shares(T.bernoulli_stats(f)), u=u)


@query(
    _E + """, rel AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i FROM (SELECT DISTINCT r FROM f) q),
    u AS (SELECT p.h, p.t, list(rel.r ORDER BY rel.i) AS free FROM (SELECT DISTINCT h, t FROM f) p, rel WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.h = p.h AND f.t = p.t AND f.r = rel.r) GROUP BY p.h, p.t)
    SELECT f.h, f.r, f.t, free[(f.h * 3 + f.t) % len(free) + 1] AS nr FROM f JOIN u USING (h, t)"""
)
def negatives_relation(s, d):
    """Facts whose relation is replaced by one that the two are not known to have."""
    return T.corrupt_relations(_facts(s, d), pick=F.col("h") * 3 + F.col("t"))


@query(
    _E + """, w AS (SELECT r, exp(-count(*) / 5000) AS p FROM f GROUP BY r), pr AS (SELECT r, p / (SELECT sum(p) FROM w) AS p FROM w),
    u AS (SELECT f.h, f.r, f.t, pr.r AS c, pr.p, ((f.h * 31 + f.t * 17) % 1000) / 1000 AS u FROM f, pr WHERE NOT EXISTS (SELECT 1 FROM f k WHERE k.h = f.h AND k.t = f.t AND k.r = pr.r)),
    s AS (SELECT *, sum(p) OVER (PARTITION BY h, r, t ORDER BY c) AS upto, sum(p) OVER (PARTITION BY h, r, t) AS whole FROM u)
    SELECT h, r, t, min(c) AS nr FROM s WHERE upto > u * whole GROUP BY h, r, t"""
)
def negatives_relation_weighted(s, d):
    """Relations drawn by their weights, those known left out."""
    f = _facts(s, d)
    weights = f.groupBy("r").agg((F.count(F.lit(1)) / 5000).alias("x"))
    u = F.pmod(F.col("h") * 31 + F.col("t") * 17, F.lit(1000)) / 1000
    return T.corrupt_relations(f, weights=weights, u=u)


@query(_E + ", n AS (SELECT *, row_number() OVER (ORDER BY h, r, t) - 1 AS n FROM f) SELECT h, r, t, n // 1000 AS batch, CASE WHEN n // 1000 % 2 = 0 THEN 'head' ELSE 'tail' END AS side FROM n")
def cross_batches(s, d):
    return T.cross_batches(_facts(s, d), ["h", "r", "t"], 1000)


@query(
    _E + """, c AS (SELECT DISTINCT h, r, t FROM (SELECT h, r, (t + 1) % 100 AS t FROM f) q) SELECT h, r, t FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.h = c.h AND f.r = c.r AND f.t = c.t)"""
)
def unknown_candidates(s, d):
    f = _facts(s, d)
    return T.unknown_only(f.select("h", "r", ((F.col("t") + 1) % 100).alias("t")).distinct(), f)


@query(
    _E + """, test AS (SELECT DISTINCT h, r, t FROM e WHERE event_id % 10 = 3), ent AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT h AS id FROM f UNION SELECT t FROM f) q), n AS (SELECT count(*) AS n FROM ent),
    c AS (SELECT test.*, (ent.i - (test.h * 5 + test.t) % n + n) % n AS far, id FROM test, ent, n),
    k AS (SELECT c.*, row_number() OVER (PARTITION BY c.h, c.r, c.t ORDER BY far) AS k FROM c ANTI JOIN f ON f.h = c.h AND f.r = c.r AND f.t = c.id)
    SELECT h, r, t, true AS positive FROM test UNION ALL SELECT h, r, id, false FROM k WHERE k = 1"""
)
def classification_test(s, d):
    """Test facts and one false fact for each, its tail replaced by the next entity that makes none."""
    f = _facts(s, d)
    test = _events(s, d).filter("event_id % 10 = 3").select("h", "r", "t").distinct()
    ends = f.select(F.col("h").alias("id")).union(f.select("t")).distinct()
    entities = durable(T.first_seen_ids(ends, "id", "id", "index"))
    pick = F.pmod(F.col("h") * 5 + F.col("t"), F.lit(entities.count()))
    false = T.corrupt(test, entities, 1, pick, tries=1, known=f)
    return test.withColumn("positive", F.lit(True)).union(false.select("h", "r", F.col("nt").alias("t"), F.lit(False).alias("positive")))


@query(_E + """, o AS (SELECT 'e' || id AS name, row_number() OVER (ORDER BY id) - 1 AS old, row_number() OVER (ORDER BY id DESC) - 1 AS id FROM (SELECT h AS id FROM f UNION SELECT t FROM f) q)
    SELECT a.id AS h, f.r, b.id AS t FROM f JOIN o a ON a.name = 'e' || f.h JOIN o b ON b.name = 'e' || f.t""")
def regenerated_ids(s, d):
    """Facts by the ids of one dictionary, written by those of another of the same names."""
    f = _facts(s, d)
    names = f.select(F.col("h").alias("n")).union(f.select("t")).distinct().withColumns({"name": F.concat(F.lit("e"), F.col("n").cast("string")), "back": -F.col("n")})
    old = durable(T.first_seen_ids(names, "name", "n", "id"))
    new = durable(T.first_seen_ids(names, "name", "back", "id"))
    key = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    facts = f.join(old.select(F.col("name").alias("a"), F.col("id").alias("ih")), key("h") == F.col("a")).join(old.select(F.col("name").alias("b"), F.col("id").alias("it")), key("t") == F.col("b"))
    return T.with_new_ids(facts.select(F.col("ih").alias("h"), "r", F.col("it").alias("t")), old, new)


# ---- files -----------------------------------------------------------------------------------------
def _text(s: SparkSession, lines: DataFrame, line: Column) -> str:
    path = _path(s)
    lines.select(line.alias("value")).write.text(path)
    return path


def _words(*parts: str | Column, separator: str = " ") -> Column:
    return F.concat_ws(separator, *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


@query(_E + " SELECT CAST(h AS VARCHAR) AS s, r, CAST(t AS VARCHAR) AS o FROM e")
def triple_file(s, d):
    return readers.triples(s, _text(s, _events(s, d), _words("h", "r", "t", separator="  ")))


@query("SELECT DISTINCT '/bin/my ' || event_type || ' ' || user_id AS name, user_id AS id FROM events")
def dictionary_file(s, d):
    """Names with blanks, written under a count line and read back."""
    names = _events(s, d).select(_words(F.lit("/bin/my"), "r", "h").alias("name"), F.col("h").alias("id")).distinct()
    path = _path(s)
    writers.dictionary_text(names, path)
    return readers.id_names(s, path)


@query("SELECT count(*) AS lines, count(*) - 1 AS counted FROM (SELECT DISTINCT event_type, user_id FROM events UNION ALL SELECT 'count', 0) q")
def dictionary_header(s, d):
    """The first line of a dictionary file holds the number of the others."""
    names = _events(s, d).select(_words("r", "h").alias("name"), F.col("h").alias("id")).distinct()
    path = _path(s)
    writers.dictionary_text(names, path)
    lines = s.read.text(path)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.max(F.when(~F.contains("value", F.lit("\t")), F.col("value"))).cast("bigint").alias("counted"))


@query(_E + " SELECT DISTINCT h, t, event_id % 7 AS r FROM e")
def id_triple_file(s, d):
    e = _events(s, d)
    lines = e.select(_words("h", "t", F.col("event_id") % 7).alias("line")).union(e.agg(F.count(F.lit(1)).cast("string")))
    return readers.id_triples(s, _text(s, lines, F.col("line")))


@query("""SELECT 'v' || vec_id AS name, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def vector_file(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").cast("array<string>").alias("v"))
    path = _text(s, e, F.concat_ws("\t", F.col("vec_id").cast("string"), F.concat(F.lit("v"), F.col("vec_id").cast("string")), F.concat(F.lit("["), F.concat_ws(", ", "v"), F.lit("]"))))
    return readers.vectors(s, path).select("name", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def numbered_text(s, d):
    """Lines with their order within the file."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    path = _text(s, e.orderBy("event_id").coalesce(1), _words("event_id", "user_id", "event_type", separator="|"))
    lines = readers.numbered_lines(s, path)
    part = lambda k: F.split_part("line", F.lit("|"), F.lit(k))
    return lines.select(part(1).cast("bigint").alias("event_id"), part(2).cast("bigint").alias("user_id"), part(3).alias("event_type"))


@query("SELECT event_id, 'said \"' || event_type || '\",' || chr(10) || 'twice' AS said FROM events")
def csv_file(s, d):
    """Quoted fields that span lines."""
    said = F.concat(F.lit('said "'), F.col("event_type"), F.lit('",\ntwice'))
    path = _path(s)
    table(s, d, "events").select("event_id", said.alias("said")).write.csv(path, quoteAll=True, escape='"')
    return readers.csv_log(s, path).select(F.col("_c0").cast("bigint").alias("event_id"), F.col("_c1").alias("said"))


@query(
    """SELECT CAST(epoch_us(ts) AS VARCHAR) AS us, '10.0.0.' || user_id AS src_ip, CASE WHEN event_type = 'click' THEN '53' ELSE '4000' END AS src_port,
    CASE WHEN event_type = 'view' THEN 'GET' END AS method, CASE WHEN event_type = 'view' THEN '/v/' || event_id END AS uri FROM events WHERE event_type <> 'error'"""
)
def packet_file(s, d):
    """Packets over TCP and UDP, with and without a request; those of IPv6 are left out."""
    e = table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    port = lambda kind, n: F.struct(F.lit(n).alias(f"{kind}.srcport"), F.lit("80").alias(f"{kind}.dstport"))
    kind = F.col("event_type")
    request = F.create_map(F.lit("GET /"), F.to_json(F.struct(F.lit("GET").alias("http.request.method"), F.concat(F.lit("/v/"), F.col("event_id").cast("string")).alias("http.request.uri"))))
    layers = F.struct(
        F.struct(F.format_string("%d.%06d", F.floor(F.col("us") / 1_000_000), F.col("us") % 1_000_000).alias("frame.time_epoch")).alias("frame"),
        F.struct(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip.src"), F.lit("10.9.9.9").alias("ip.dst")).alias("ip"),
        F.when(kind == "error", F.struct(F.lit("fe80::1").alias("ipv6.src"))).alias("ipv6"), F.when(kind != "click", port("tcp", "4000")).alias("tcp"),
        F.when(kind == "click", port("udp", "53")).alias("udp"), F.when(kind == "view", request).alias("http"),
    )
    path = _text(s, e, F.to_json(F.struct(F.struct(layers.alias("layers")).alias("_source"))))
    read = readers.packets(s, path)
    return read.select((F.col("time") * 1_000_000).cast("bigint").cast("string").alias("us"), "src_ip", "src_port", "method", "uri")


@query("SELECT user_id AS run, round(avg(value), 4) AS mrr, round(max(value), 4) AS hits FROM events GROUP BY user_id")
def result_files(s, d):
    """One result file a run, its parameters in its name."""
    e = table(s, d, "events").groupBy("user_id").agg(F.format_string("%.4f", F.avg("value")).alias("a"), F.format_string("%.4f", F.max("value")).alias("b"))
    path = _path(s)
    text = F.concat(F.lit("MRR: "), F.col("a"), F.lit("\nHits: "), F.col("b"), F.lit("\n"))
    e.select(F.col("user_id").alias("run"), text.alias("value")).repartition("run").write.partitionBy("run").text(path, lineSep="\n\n")
    read = readers.result_metrics(s, path, ["MRR", "Hits"])
    run = F.regexp_extract("file", r"run=(\d+)", 1).cast("bigint")
    return read.select(run.alias("run"), F.round("MRR", 4).alias("mrr"), F.round("Hits", 4).alias("hits"))


@query("SELECT DISTINCT 'out/lr' || user_id || '_' || event_type || '_x.txt' AS file, 'lr' || user_id AS rate, event_type AS model FROM events")
def file_name_parts(s, d):
    names = table(s, d, "events").select(F.concat(F.lit("out/lr"), F.col("user_id").cast("string"), F.lit("_"), "event_type", F.lit("_x.txt")).alias("file")).distinct()
    return readers.name_parts(names, "file", ["rate", "model"])


@query("SELECT CAST(a AS VARCHAR) AS lr, CAST(b AS VARCHAR) AS dim FROM (SELECT unnest([1, 2, 3]) AS a) x, (SELECT unnest([10, 20]) AS b) y")
def parameter_grid(s, d):
    return readers.parameter_grid(s, {"lr": [1, 2, 3], "dim": [10, 20]})


# ---- written and read back -------------------------------------------------------------------------
@query(
    _E + """, n AS (SELECT r AS graph_id, h AS name, arg_min(CASE WHEN value > 50 THEN 'd' || t END, event_id) FILTER (value > 50) AS entity_data FROM e GROUP BY r, h)
    SELECT graph_id, CAST(name AS VARCHAR) AS name, entity_data FROM n"""
)
def graph_written(s, d):
    """Nodes once by name, the first data that is there winning."""
    e = _events(s, d)
    data = F.when(F.col("value") > 50, F.concat(F.lit("d"), F.col("t").cast("string")))
    nodes = e.select(F.col("r").alias("graph_id"), F.col("h").cast("string").alias("name"), F.lit("Process").alias("entity_type"), data.alias("entity_data"), F.col("event_id").alias("seq"))
    path = _path(s)
    writers.graph(nodes, e.select(F.col("r").alias("graph_id"), "h", "t"), path, order="seq")
    return s.read.parquet(f"{path}/nodes").select("graph_id", "name", "entity_data")


@query(_E + " SELECT r AS graph_id, count(*) AS n, sum(h) AS total FROM e GROUP BY r")
def graph_edges_written(s, d):
    e = _events(s, d)
    path = _path(s)
    nodes = e.select(F.col("r").alias("graph_id"), F.col("h").cast("string").alias("name"), F.lit("x").alias("entity_type"), F.lit("y").alias("entity_data"), F.col("event_id").alias("seq"))
    writers.graph(nodes, e.select(F.col("r").alias("graph_id"), "h", "t"), path, order="seq")
    return s.read.parquet(f"{path}/edges").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("total"))


@query(_E + ", a AS (SELECT h, t, min(value) AS value FROM e WHERE r = 'click' GROUP BY h, t), b AS (SELECT h, t, max(value) AS value FROM e WHERE r = 'view' GROUP BY h, t) SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.h = a.h AND b.t = a.t)")
def rows_upserted(s, d):
    e = _events(s, d)
    old, new = e.filter("r = 'click'").groupBy("h", "t").agg(F.min("value").alias("value")), e.filter("r = 'view'").groupBy("h", "t").agg(F.max("value").alias("value"))
    return writers.upserted(old, new, ["h", "t"])


@query(
    """WITH n AS (SELECT DISTINCT net_id, s_ip FROM netlogs), a AS (SELECT app_id, host, row_number() OVER (ORDER BY app_id) - 1 AS p FROM (SELECT DISTINCT app_id, host FROM apachelogs) q),
    l AS (SELECT n.net_id, min(a.p) AS p FROM n JOIN a ON a.host = n.s_ip GROUP BY n.net_id), z AS (SELECT net_id, row_number() OVER (ORDER BY net_id) - 1 AS position FROM n)
    SELECT z.net_id, z.position, CAST(coalesce(l.p, -1) AS VARCHAR) AS app_position FROM z LEFT JOIN l USING (net_id)"""
)
def correlation_written(s, d):
    """Nets and applications in order, every net with the position of its application or -1, written as JSON and read back."""
    nets = table(s, d, "netlogs").select("net_id", "s_ip").distinct()
    apps = table(s, d, "apachelogs").select("app_id", "host").distinct()
    links = nets.join(apps, nets.s_ip == apps.host).groupBy("net_id").agg(F.min("app_id").alias("app_id"))
    path = _path(s)
    writers.correlation_document(nets, apps, links, "net_id", "app_id", path)
    return s.read.schema("net_id bigint, position bigint, app_position string").json(f"{path}/nets")


@query(_E + " SELECT us AS ts_us, h AS pid, r AS action FROM e")
def audit_table_written(s, d):
    e = _events(s, d).select(F.col("us").alias("ts_us"), F.col("h").alias("pid"), F.col("r").alias("action"))
    path = _path(s)
    writers.audit_rows(e, path)
    return s.read.schema("ts_us bigint, pid bigint, action string").csv(path, sep="\t", header=True)


@query(_E + ", n AS (SELECT CAST(h % 3 AS INTEGER) AS snapshot, h, r, t FROM e) SELECT snapshot, count(*) AS n, count(DISTINCT h) AS heads FROM n GROUP BY snapshot")
def snapshots_written(s, d):
    path = _path(s)
    writers.dictionary(_events(s, d).select((F.col("h") % 3).cast("int").alias("snapshot"), "h", "r", "t"), path, "snapshot")
    return s.read.parquet(path).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("heads"))


@query(_E + " SELECT r, count(*) AS n FROM e GROUP BY r")
def report_written(s, d):
    path = _path(s)
    writers.report(_events(s, d).groupBy("r").agg(F.count(F.lit(1)).alias("n")), path)
    return s.read.schema("r string, n bigint").csv(path, header=True)


@query(_E + """ SELECT '"' || h || '" -> "' || t || '" [label="say \\"' || r || '\\""];' AS line FROM f""")
def dot_written(s, d):
    relation = F.concat(F.lit('say "'), "r", F.lit('"'))
    return writers.dot_lines(_facts(s, d).select(F.col("h").cast("string").alias("src"), F.col("t").cast("string").alias("dst"), relation.alias("relation")))

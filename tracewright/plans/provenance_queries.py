"""Named queries over provenance edges: noise, calls, directions, times, claims and scores; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import names, parsers
from tracewright.operators import audit as A
from tracewright.operators import correlate as C
from tracewright.operators import graph as G
from tracewright.operators import ordering as O
from tracewright.operators import rules
from tracewright.operators import triples as T
from tracewright.plans import pipeline
from tracewright.session import table

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


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: Edges once each with the call written one way; the SQL and the DataFrame form.
_CALL = "'sys_' || regexp_replace(lower(trim(log_type, ' ' || chr(9) || chr(39) || chr(34))), '^_*sys_|\\(\\)$', '', 'g')"
_E = f"""WITH d AS (SELECT DISTINCT edge_key, graph_id, subject_name, object_name, object_type, {_CALL} AS call, epoch_us(event_ts) AS us,
  data_source, unit_label FROM edges)"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges").select(
        "edge_key", "graph_id", "subject_name", "object_name", "object_type", F.concat(F.lit("sys_"), names.call(F.col("log_type"))).alias("call"),
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"), "data_source", "unit_label",
    ).distinct()


# ---- what is left out ------------------------------------------------------------------------------
def _noise(column: str) -> str:
    parts = " OR ".join(f"contains({column}, {_texts([p])})" for p in G.NOISE_PARTS)
    return f"({column} IS NULL OR {column} IN ({_texts(G.NOISE_NAMES)}) OR {parts})"


@query(f"{_E} SELECT edge_key FROM d WHERE NOT {_noise('subject_name')} AND NOT {_noise('object_name')}")
def noise_default(s, d):
    return G.merge_nodes(_edges(s, d).withColumnsRenamed({"subject_name": "src", "object_name": "dst"})).select("edge_key")


@query(f"{_E} SELECT edge_key, call FROM d WHERE call IS NULL OR call NOT IN ({_texts(G.NOISE_CALLS)})")
def noise_calls(s, d):
    return G.without_calls(_edges(s, d), G.NOISE_CALLS, "call").select("edge_key", "call")


_BEGINS = {"audit": 1_641_300_000_000_000, "app": 1_641_400_000_000_000}


@query(
    f"""{_E} SELECT edge_key FROM d WHERE (call IS NULL OR call NOT IN ('sys_stat', 'sys_lstat')) AND NOT coalesce(data_source = 'audit' AND us < {_BEGINS["audit"]}, false)
    AND NOT coalesce(data_source = 'app' AND us < {_BEGINS["app"]}, false)"""
)
def source_cutoffs(s, d):
    return G.since(G.without_calls(_edges(s, d), G.LOOK_CALLS, "call"), "us", "data_source", _BEGINS).select("edge_key")


@query(
    f"""{_E}, r AS (SELECT unit_label, min(us) + 1000000 AS lo, max(us) AS hi FROM d WHERE unit_label IS NOT NULL GROUP BY unit_label)
    SELECT edge_key FROM d LEFT JOIN r USING (unit_label) WHERE lo IS NULL OR hi IS NULL OR (us >= lo AND us <= hi)"""
)
def range_or_null(s, d):
    e = _edges(s, d)
    ranges = e.filter("unit_label is not null").groupBy("unit_label").agg((F.min("us") + 1_000_000).alias("lo"), F.max("us").alias("hi"))
    return e.join(ranges, "unit_label", "left").filter(G.in_range(F.col("us"), F.col("lo"), F.col("hi"))).select("edge_key")


@query(f"{_E} SELECT DISTINCT object_name AS name, object_type AS entity_type FROM d WHERE object_type IN ('File', 'Socket')")
def nodes_of_kind(s, d):
    nodes = _edges(s, d).select(F.col("object_name").alias("name"), F.col("object_type").alias("entity_type")).distinct()
    return G.of_kind(nodes, ["File", "Socket"])


@query(
    """WITH e AS (SELECT edge_key, data_source, log_data FROM (SELECT *, row_number() OVER (PARTITION BY edge_key ORDER BY ingested_at) AS k FROM edges) q WHERE k = 1),
    x AS (SELECT *, upper(coalesce(map_extract_value(log_data, 'protocol'), '')) AS p, coalesce(map_extract_value(log_data, 'ip'), '') AS ip, map_extract_value(log_data, 'port') AS port FROM e)
    SELECT edge_key FROM x WHERE data_source IS NULL OR data_source <> 'net' OR NOT (port IS NULL OR p IN ('DNS', 'TCP') OR ip = '255.255.255.255')"""
)
def net_noise_filter(s, d):
    return G.drop_net_noise(table(s, d, "edges").select("edge_key", "data_source", "log_data").dropDuplicates(["edge_key"])).select("edge_key")


@query(
    f"""{_E}, n AS (SELECT graph_id, subject_name AS name FROM d UNION SELECT graph_id, object_name FROM d),
    k AS (SELECT * FROM d WHERE NOT {_noise("subject_name")} AND NOT {_noise("object_name")}),
    x AS (SELECT graph_id, subject_name AS name FROM k UNION SELECT graph_id, object_name FROM k)
    SELECT n.graph_id, n.name FROM n JOIN x ON x.graph_id = n.graph_id AND x.name = n.name"""
)
def isolates_dropped(s, d):
    e = _edges(s, d).withColumnsRenamed({"subject_name": "src", "object_name": "dst"})
    nodes = e.select("graph_id", F.col("src").alias("name")).union(e.select("graph_id", "dst")).distinct()
    return G.drop_isolates(nodes, G.merge_nodes(e), ["graph_id"], "name")


# ---- directions and calls --------------------------------------------------------------------------
@query(
    f"""{_E}, x AS (SELECT *, subject_name AS p, CASE WHEN object_type IN ('File', 'Socket') OR (object_type = 'Process' AND call LIKE '%clone') THEN object_name END AS o,
      call IN ({_texts(A.REVERSED)}) AS turned FROM d)
    SELECT edge_key, CASE WHEN turned THEN o ELSE p END AS src, CASE WHEN turned THEN p ELSE o END AS dst,
      CASE WHEN turned THEN 'Process' ELSE object_type END AS dst_type FROM x WHERE p IS NOT NULL AND o IS NOT NULL AND call IS NOT NULL"""
)
def directed_edges(s, d):
    kind = F.col("object_type")
    rows = _edges(s, d).filter("call is not null").select(
        "edge_key", F.col("subject_name").alias("process_name"), F.when(kind == "File", F.col("object_name")).alias("file"),
        F.when(kind == "Socket", F.col("object_name")).alias("ip"), F.lit(None).cast("int").alias("port"),
        F.when(kind == "Process", F.col("object_name")).alias("child"), F.col("call").alias("action"), F.col("us").alias("ts_us"),
    )
    return G.build_edges(rows, A.REVERSED, ["edge_key"]).select("edge_key", "src", "dst", "dst_type")


@query(
    f"""{_E}, c AS (SELECT DISTINCT substr(call, 5) AS name FROM d WHERE call IS NOT NULL)
    SELECT name, CASE WHEN name IN ({_texts(A.DUAL_PATH)}) THEN 'paths' WHEN name IN ({_texts(A.PATH)}) THEN 'path' WHEN name IN ({_texts(A.SOCKET)}) THEN 'socket'
      WHEN name IN ({_texts([*A.FILE_FD, *A.NET_FD, *A.POLL_FD])}) THEN 'descriptor' END AS touches FROM c"""
)
def call_classes(s, d):
    calls = _edges(s, d).filter("call is not null").select(F.substring("call", 5, 100).alias("name")).distinct()
    return calls.withColumn("touches", A.touched_by(F.col("name")))


@query(
    f"""{_E}, x AS (SELECT edge_key, us, CASE data_source WHEN 'app' THEN 'Apache_app' ELSE data_source END AS source FROM d WHERE us IS NOT NULL)
    SELECT edge_key, CASE WHEN source = 'audit' THEN us // 1000 WHEN source = 'Apache_app' THEN us // 1000000 * 1000 WHEN source = 'net' THEN us // 1000 ELSE us END AS ms FROM x"""
)
def time_base(s, d):
    """Times printed as each source prints them (microseconds, seconds, seconds with fraction), read back to milliseconds."""
    source = F.when(F.col("data_source") == "app", "Apache_app").otherwise(F.col("data_source"))
    printed = F.when(source == "Apache_app", F.floor(F.col("us") / 1_000_000).cast("string"))
    printed = printed.when(source == "net", F.format_string("%d.%06d", F.floor(F.col("us") / 1_000_000), F.pmod("us", F.lit(1_000_000)))).otherwise(F.col("us").cast("string"))
    return _edges(s, d).filter("us is not null").select("edge_key", G.time_ms(printed, source).alias("ms"))


# ---- relations and labels --------------------------------------------------------------------------
@query(f"{_E} SELECT DISTINCT subject_name AS src, object_name AS dst, edge_key AS edge_id FROM d WHERE call = 'sys_rename'")
def label_pairs(s, d):
    e = _edges(s, d).withColumnsRenamed({"subject_name": "src", "object_name": "dst", "call": "relation", "edge_key": "edge_id"})
    return G.labelled_pairs(e, "sys_rename")


@query(
    f"""{_E}, p AS (SELECT subject_name AS name FROM d WHERE call = 'sys_rename' UNION SELECT object_name FROM d WHERE call = 'sys_rename')
    SELECT DISTINCT object_name AS name, object_type AS entity_type FROM d WHERE object_type IN ('File', 'Socket') AND object_name IN (SELECT name FROM p WHERE name IS NOT NULL)"""
)
def label_nodes(s, d):
    e = _edges(s, d).withColumnsRenamed({"subject_name": "src", "object_name": "dst", "call": "relation", "edge_key": "edge_id"})
    nodes = e.select(F.col("dst").alias("name"), F.col("object_type").alias("entity_type"))
    return G.labelled_nodes(e, nodes, "sys_rename", ["File", "Socket"])


_EV = """WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id AS src, event_type AS rel, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst, value FROM events)"""


def _events(s: SparkSession, d: str) -> DataFrame:
    return T.edge_view(table(s, d, "events")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


@query(
    _EV + """ SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM e i WHERE i.us // 86400000000 = e.us // 86400000000 AND i.dst = e.src AND i.rel = e.rel AND i.us <= e.us)"""
)
def fed_before(s, d):
    e = _events(s, d).withColumns({"day": F.floor(F.col("us") / 86_400_000_000), "label": F.col("rel"), "start": F.col("us")})
    return G.fed_before(e, ["day"]).select("event_id")


@query(
    _EV + """, a AS (SELECT DISTINCT rel, dst FROM e WHERE us < 1704672000000000), b AS (SELECT DISTINCT rel, dst FROM e WHERE us >= 1704672000000000 AND src < 40)
    SELECT rel, dst FROM a EXCEPT SELECT rel, dst FROM b"""
)
def prototype_difference(s, d):
    e = _events(s, d)
    a, b = e.filter("us < 1704672000000000"), e.filter("us >= 1704672000000000 and src < 40")
    return T.difference(a.select("rel", "dst"), b.select("rel", "dst"))


@query("""SELECT min(line_id) AS line_id FROM loglines WHERE raw IS NOT NULL GROUP BY substr(raw, 32)""")
def text_dedupe_from_char(s, d):
    return O.first_of_text(table(s, d, "loglines"), "raw", "line_id", 32).select("line_id")


@query(
    _EV + """, h AS (SELECT src, list(rel ORDER BY us, event_id) AS history FROM e GROUP BY src)
    SELECT history[-2] AS label, count(*) AS n FROM h WHERE len(history) >= 2 GROUP BY 1"""
)
def score_overwrites(s, d):
    history = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "rel"))), lambda x: x["rel"])
    return C.overwrites(_events(s, d).groupBy("src").agg(history.alias("history")), "history")


@query(
    """WITH d AS (SELECT DISTINCT edge_key, unit_label, map_extract_value(log_data, 'pid') AS pid FROM edges WHERE unit_label IS NOT NULL AND log_data IS NOT NULL),
    u AS (SELECT unit_label, min(pid) AS own FROM d GROUP BY unit_label)
    SELECT unit_label AS label, count(*) AS n FROM d JOIN u USING (unit_label) WHERE pid <> own GROUP BY unit_label"""
)
def pid_mismatches(s, d):
    e = table(s, d, "edges").filter("unit_label is not null and log_data is not null").select("edge_key", F.col("unit_label").alias("label"), F.try_element_at("log_data", F.lit("pid")).alias("pid")).distinct()
    units = e.groupBy("label").agg(F.min("pid").alias("own"))
    found = C.mismatched(e, units, "label", "pid", "own")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- scores ----------------------------------------------------------------------------------------
_WINDOW = 600_000_000
_UNITS = _EV + """, u AS (SELECT event_id AS label, us AS app_us, {second} AS app2_us, src, dst, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS payload FROM e WHERE rel = 'purchase'),
  nets AS (SELECT u.label, n.us, n.dst FROM u JOIN e n ON n.rel = 'view' AND n.src = u.src),
  vals AS (SELECT label, CAST(src AS VARCHAR) AS v FROM u UNION ALL SELECT label, CAST(dst AS VARCHAR) FROM u UNION ALL SELECT DISTINCT label, CAST(dst AS VARCHAR) FROM nets),
  h AS MATERIALIZED (SELECT label, v, count(*) AS n FROM vals GROUP BY label, v), w AS (SELECT label, sum(n) AS a FROM h GROUP BY label),
  c AS (SELECT event_id, us, CAST(dst AS VARCHAR) AS subject, CAST((dst + 3) % 100 AS VARCHAR) AS object FROM e WHERE rel = 'click'),
  p AS MATERIALIZED (SELECT c.*, u.label, u.app_us, u.app2_us, u.payload FROM c JOIN u ON c.us >= least(app_us, app2_us) - {window} AND c.us <= greatest(app_us, app2_us) + {window}),
  m AS (SELECT p.event_id, p.label, min(abs(p.us - nets.us)) AS near FROM p JOIN nets ON nets.label = p.label GROUP BY p.event_id, p.label),
  q AS (SELECT p.event_id, p.label, ln(1 + 1 / (least(abs(p.us - app_us), abs(p.us - app2_us), coalesce(m.near, 9e18)) / 1000 + 1e-9)) AS s1,
      greatest(coalesce(hs.n, 0), CASE WHEN contains(payload, subject) THEN 1 ELSE 0 END) AS b1, greatest(coalesce(ho.n, 0), CASE WHEN contains(payload, object) THEN 1 ELSE 0 END) AS b2, a
    FROM p JOIN w USING (label) LEFT JOIN m ON m.event_id = p.event_id AND m.label = p.label
    LEFT JOIN h hs ON hs.label = p.label AND hs.v = p.subject LEFT JOIN h ho ON ho.label = p.label AND ho.v = p.object),
  s AS (SELECT event_id, label, s1, ((CASE WHEN b1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN b2 > 0 THEN 1 ELSE 0 END)) / 2 * exp((b1 + b2) / a) AS s2 FROM q),
  b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s1 + s2 DESC, label) AS k FROM s WHERE s2 <> 0)
  SELECT event_id, label, round(s1, 5) AS s1, round(s2, 5) AS s2 FROM b WHERE k = 1"""


def _scored(s: SparkSession, d: str, second: Column) -> DataFrame:
    e = _events(s, d)
    own = F.array(F.col("src").cast("string"), F.col("dst").cast("string")).alias("own")
    units = e.filter("rel = 'purchase'").select(F.col("event_id").alias("label"), "src", F.array(F.col("us"), second).alias("app_at"), F.floor("value").cast("string").alias("payload"), own)
    nets = e.filter("rel = 'view'").select("src", F.col("us").alias("at"), F.col("dst").cast("string").alias("v"))
    events = e.filter("rel = 'click'").select("event_id", F.col("us").alias("at"), F.col("dst").cast("string").alias("subject"), ((F.col("dst") + 3) % 100).cast("string").alias("object"))
    best = C.best_labels(events, units, nets, _WINDOW, by="src")
    return best.select("event_id", "label", F.round("s1", 5).alias("s1"), F.round("s2", 5).alias("s2"))


@query(_UNITS.format(second="us", window=_WINDOW))
def best_label_one_app(s, d):
    return _scored(s, d, F.col("us"))


@query(_UNITS.format(second="us + event_id % 7 * 60000000", window=_WINDOW))
def best_label_two_apps(s, d):
    return _scored(s, d, F.col("us") + F.col("event_id") % 7 * 60_000_000)


# ---- processes -------------------------------------------------------------------------------------
_PROC = """WITH r AS (SELECT event_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'sys_clone' WHEN 'error' THEN 'sys_execve' ELSE 'sys_read' END AS action, user_id AS pid,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, CASE WHEN value > 20 THEN chr(97 + CAST(user_id % 5 AS INT)) END AS name FROM events)"""


@query(
    _PROC + """, clones AS (SELECT pid, k AS child, us, event_id FROM r WHERE action = 'sys_clone'),
    parents AS (SELECT DISTINCT pid FROM clones), named AS (SELECT pid, arg_min(name, (us, event_id)) AS name FROM r WHERE name IS NOT NULL GROUP BY pid),
    up AS (SELECT child, arg_min(pid, (us, event_id)) AS parent FROM clones GROUP BY child),
    x AS (SELECT r.event_id, r.us, r.pid, r.k AS ppid, r.name, coalesce(n.name, g.name) AS parent_name FROM r JOIN parents p ON p.pid = r.k
      LEFT JOIN named n ON n.pid = r.k LEFT JOIN up ON up.child = r.k LEFT JOIN named g ON g.pid = up.parent WHERE action = 'sys_execve')
    SELECT event_id, ppid, pid, parent_name, name FROM x WHERE NOT coalesce(name = parent_name AND name IN ('a', 'b'), false)"""
)
def synthetic_clones(s, d):
    e = _events(s, d)
    action = F.when(F.col("rel") == "signup", "sys_clone").when(F.col("rel") == "error", "sys_execve").otherwise("sys_read")
    name = F.when(F.col("value") > 20, F.chr(97 + F.col("src") % 5))
    rows = e.select("event_id", "us", action.alias("action"), F.col("src").alias("pid"), F.col("dst").alias("k"), name.alias("name"))
    clones = rows.filter("action = 'sys_clone'").select("pid", F.col("k").alias("child"), "us", "event_id")
    runs = rows.filter("action = 'sys_execve'").select("event_id", "us", "pid", F.col("k").alias("ppid"), "name")
    made = C.synthetic_clones(runs, clones, rows.select("pid", "name", "us", "event_id"), ["us", "event_id"], ["a", "b"])
    return made.select("event_id", "ppid", "pid", "parent_name", "name")


@query()
def compressed_chain(s, d):
    """The whole compression: noise nodes, causality, equal events, network noise."""
    edges = table(s, d, "edges").dropDuplicates(["edge_key"]).select(
        "edge_key", "graph_id", F.col("subject_name").alias("src"), F.col("object_name").alias("dst"), F.concat(F.lit("sys_"), names.call(F.col("log_type"))).alias("relation"),
        "data_source", F.unix_micros(F.col("event_ts").cast("timestamp")).cast("string").alias("stamp"), "log_data",
    )
    return pipeline.compress(edges.filter("stamp is not null"), ["graph_id"], "edge_key")


# ---- rules -----------------------------------------------------------------------------------------
_RULE = {"host": "10.44.201.87", "response_code": "200"}


@query(
    """SELECT DISTINCT app_id, host = '10.44.201.87' AND response_code = '200' AS fits, CASE WHEN contains(url, '/www/') AND contains(url, '.js') THEN 'script'
      WHEN contains(url, '.png') THEN 'image' END AS class FROM apachelogs WHERE host IS NOT NULL AND response_code IS NOT NULL AND url IS NOT NULL"""
)
def rule_classes(s, d):
    logs = table(s, d, "apachelogs").filter("host is not null and response_code is not null and url is not null")
    kinds = rules.equality_class(F.col("url"), {"script": ["/www/", ".js"], "image": [".png"]})
    return logs.select("app_id", rules.fits(_RULE).alias("fits"), kinds.alias("class")).distinct()


@query(
    _EV + """ SELECT event_id, (us % 50 <= us % 70 + 5 AND us % 50 + 10 >= us % 70) AS together,
      CASE WHEN contains('/' || dst || '/x', CAST(src % 10 AS VARCHAR)) THEN 1 ELSE 0 END AS relevant FROM e"""
)
def overlap_and_relevance(s, d):
    a, b = F.col("us") % 50, F.col("us") % 70
    payload = F.concat(F.lit("/"), F.col("dst").cast("string"), F.lit("/x"))
    subject = F.concat(F.lit("/srv/"), (F.col("src") % 10).cast("string"))
    return _events(s, d).select("event_id", G.overlapping(a, a + 10, b, b + 5).alias("together"), parsers.payload_relevant(payload, subject, "/srv/").alias("relevant"))


@query(_EV + " SELECT event_id, CASE WHEN event_id % 100 = 7 THEN 3 WHEN event_id % 100 = 8 THEN 2 ELSE 1 END AS times FROM e")
def augmented_copies(s, d):
    e = _events(s, d).select("event_id", (F.col("event_id") % 100).alias("graph"))
    return rules.augmented(e, "graph", {7: 3, 8: 2}).groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("times"))

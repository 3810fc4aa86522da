"""Named queries over raw log rows: program layouts, rules and weights on the log tables; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import names, parsers
from tracewright.operators import correlate as C
from tracewright.operators import rules
from tracewright.operators import triples as T
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


#: The fields of a row, told by one pattern: escaped characters, quoted and (where wanted) bracketed texts belong to their field.
_FIELDS = r"""(?:\\(?:.|\n)|"(?:\\(?:.|\n)|[^"\\])*"|{bracketed}[^\s"\\{open}]|\\)+"""
_WITH = _FIELDS.replace("{bracketed}", r"""\[(?:\\(?:.|\n)|[^\]"\\])*\]|\[|""").replace("{open}", r"\[")
_WITHOUT = _FIELDS.replace("{bracketed}", "").replace("{open}", "")
_BARE = r"""regexp_replace(regexp_replace(regexp_replace({x}, $re$^"((?:\\(?:.|\n)|[^"\\])*)"$$re$, '\1'),
  $re$^\[((?:\\(?:.|\n)|[^\[\]\\])*)\]$$re$, '\1'), $re$\\([\\"\[\]\s])$re$, '\1', 'g')"""


def _fields_sql(feed: str, pattern: str) -> str:
    return f"""WITH q AS (SELECT DISTINCT row_id, rtrim(raw, chr(13)) AS raw FROM accessrows WHERE feed = '{feed}'),
  w AS (SELECT row_id, raw, regexp_extract_all(raw, $re${pattern}$re$) AS parts, regexp_replace(raw, $re$\\\\.$re$, '', 'g') AS plain FROM q),
  p AS (SELECT row_id, len(plain) - len(replace(plain, '"', '')) AS quotes, parts, list_transform(parts, lambda x: {_BARE.format(x="x")}) AS f FROM w)"""


_ACCESS = _fields_sql("ApacheLog", _WITH) + """,
  r AS (SELECT row_id, CASE WHEN quotes % 2 = 0 AND len(f) IN (7, 11) AND regexp_matches(parts[4], $re$^\\[.*\\]$$re$) THEN f END AS f FROM p)"""


def _access_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "accessrows").filter("feed = 'ApacheLog'").select("row_id", F.rtrim("raw", F.lit("\r")).alias("raw")).distinct()


@query(
    _ACCESS + """ SELECT row_id, nullif(f[1], '') AS host, nullif(f[4], '') AS "time", nullif(f[6], '') AS response_code, nullif(f[7], '') AS transfer_size,
    nullif(f[9], '') AS dst_ip, nullif(f[10], '') AS dst_port, nullif(f[11], '') AS pid, nullif(regexp_extract(f[5], '^([^\\s]+) ', 1), '') AS method FROM r"""
)
def apache_fields(s, d):
    """Every row of the feed; rows that are no access line (field count, quoting, time) have null fields."""
    fields = parsers.apache(F.col("raw"))
    keep = ["host", "time", "response_code", "transfer_size", "dst_ip", "dst_port", "pid", "method"]
    return _access_rows(s, d).withColumn("f", fields).select("row_id", *[F.col(f"f.{c}") for c in keep])


@query(_ACCESS + " SELECT nullif(f[1], '') AS host, count(*) AS n, CAST(sum(CASE WHEN f[6] >= '400' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM r GROUP BY 1")
def host_activity(s, d):
    """Rows and failures per host; the null host counts the rows that are no access line."""
    f = apache_fields(s, d)
    failed = F.coalesce((F.col("response_code") >= "400").cast("bigint"), F.lit(0).cast("bigint"))
    return f.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed"))


@query(
    _fields_sql("ProftpdLog", _WITHOUT) + """,
    r AS (SELECT row_id, CASE WHEN quotes % 2 = 0 AND len(f) = 18 AND regexp_matches(array_to_string(f[1:5], ' '), $re$^\\S+ \\S+ \\d+ \\S+ \\d{4}$$re$) THEN f END AS f FROM p)
    SELECT row_id, CASE WHEN f IS NOT NULL THEN array_to_string(f[1:5], ' ') END AS "time", nullif(f[7], '') AS host, nullif(f[8], '') AS transfer_size,
    nullif(f[9], '') AS file, nullif(f[11], '') AS transfer_status, nullif(f[18], '') AS ftp_command FROM r"""
)
def proftpd_fields(s, d):
    """Every row of the feed; rows that are no transfer line (field count, quoting) have null fields."""
    rows = table(s, d, "accessrows").filter("feed = 'ProftpdLog'").select("row_id", F.rtrim("raw", F.lit("\r")).alias("raw")).distinct()
    keep = ["time", "host", "transfer_size", "file", "transfer_status", "ftp_command"]
    return rows.withColumn("f", parsers.proftpd(F.col("raw"))).select("row_id", *[F.col(f"f.{c}") for c in keep])


_IP = "replace(lower(trim({c})), '::ffff:', '')"
_APPS = f"""a AS (SELECT app_id, epoch_us(app_time) AS us, host, url, {_IP.format(c="dst_ip")} AS dst FROM apachelogs WHERE app_time IS NOT NULL GROUP BY ALL),
  n AS (SELECT net_id, {_IP.format(c="s_ip")} AS src, {_IP.format(c="d_ip")} AS dst, protocol_name, httpdata FROM netlogs GROUP BY ALL)"""


def _apps(s, d):
    return table(s, d, "apachelogs").filter("app_time is not null").select(
        "app_id", F.unix_micros(F.col("app_time").cast("timestamp")).alias("us"), "host", "url", names.address(F.col("dst_ip")).alias("dst")
    ).distinct()


def _nets(s, d):
    return table(s, d, "netlogs").select(
        "net_id", names.address(F.col("s_ip")).alias("src"), names.address(F.col("d_ip")).alias("dst"), "protocol_name", "httpdata"
    ).distinct()


@query(
    f"""WITH {_APPS}, l AS (SELECT host, min(app_id) AS app_id FROM a GROUP BY host), m AS (SELECT url, min(app_id) AS app_id FROM a GROUP BY url),
    x AS (SELECT n.net_id, l.app_id FROM n JOIN l ON l.host = n.src UNION ALL SELECT n.net_id, l.app_id FROM n JOIN l ON l.host = n.dst
      UNION ALL SELECT n.net_id, m.app_id FROM n JOIN m ON m.url = n.httpdata WHERE upper(coalesce(n.protocol_name, '')) <> 'TCP')
    SELECT net_id AS net_seq, min(app_id) AS app_seq FROM x GROUP BY net_id"""
)
def apache_connect(s, d):
    apps = _apps(s, d).withColumnRenamed("app_id", "app_seq")
    nets = _nets(s, d).withColumnsRenamed({"net_id": "net_seq", "protocol_name": "protocol", "httpdata": "payload"})
    return rules.apache(apps, nets)


@query(
    f"""WITH {_APPS}, x AS (SELECT app_id, dst, host, row_number() OVER (PARTITION BY dst, host ORDER BY us, app_id) AS k FROM a),
    y AS (SELECT net_id, src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY net_id) AS k FROM n)
    SELECT y.net_id, x.app_id FROM x JOIN y ON y.src = x.dst AND y.dst = x.host AND y.k = x.k"""
)
def nth_packet_to_nth_request(s, d):
    a = _apps(s, d).select(F.col("dst").alias("server"), F.col("host").alias("client"), "app_id", "us")
    b = _nets(s, d).select(F.col("src").alias("server"), F.col("dst").alias("client"), "net_id")
    return C.rank_to_rank(a, b, ["server", "client"], ["us", "app_id"], ["net_id"]).select("net_id", "app_id")


_T = """d AS (SELECT DISTINCT edge_key, graph_id, trim(subject_name, ' ' || chr(9) || chr(39) || chr(34)) AS s,
  regexp_replace(lower(trim(log_type)), '^sys_', '') AS r FROM edges WHERE subject_name IS NOT NULL AND log_type IS NOT NULL)"""


@query(
    f"""WITH {_T}, w AS (SELECT s, r, count(DISTINCT graph_id) AS df, (SELECT count(DISTINCT graph_id) FROM d) AS n FROM d GROUP BY s, r)
    SELECT s, r, df, round(df / n, 6) AS tf, round(log10((n + 1) / (df + 1)), 6) AS idf FROM w"""
)
def subject_call_weights(s, d):
    edges = table(s, d, "edges").select("edge_key", "graph_id", names.bare(F.col("subject_name")).alias("s"), names.call(F.col("log_type")).alias("r"))
    w = T.term_frequency(edges.filter("s is not null and r is not null"), "graph_id", ["s", "r"])
    return w.select("s", "r", "df", F.round("tf", 6).alias("tf"), F.round("idf", 6).alias("idf"))

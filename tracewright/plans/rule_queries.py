"""Named queries of the correlation rules: events stand in for application and network records; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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


_S = """WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id AS u, event_type AS rel, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, value FROM events),
  a AS MATERIALIZED (SELECT event_id AS app_seq, us AS "at", 'h' || u % 20 AS host, 'u' || k % 30 AS url, CAST(k AS VARCHAR) AS port, u % 7 AS pid,
    CASE WHEN value > 50 THEN 'Connect' ELSE 'Disconnect' END AS state, 'u' || k % 30 AS statement FROM e WHERE rel = 'purchase'),
  n AS MATERIALIZED (SELECT event_id AS net_seq, us AS "at", 'h' || u % 20 AS src, 'h' || k % 20 AS dst, CAST(k AS VARCHAR) AS src_port, CAST(u AS VARCHAR) AS dst_port,
    CASE WHEN value > 50 THEN 'TCP' ELSE 'HTTP' END AS protocol, 'u' || k % 30 AS payload, CASE WHEN rel = 'view' THEN 'f' || k END AS file FROM e WHERE rel IN ('click', 'view')),
  y AS MATERIALIZED (SELECT *, least(src || '|' || src_port, dst || '|' || dst_port) || '~' || greatest(src || '|' || src_port, dst || '|' || dst_port) AS key FROM n)"""


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T.edge_view(table(s, d, "events")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    u, k = F.col("src"), F.col("dst")
    apps = e.filter("rel = 'purchase'").select(
        F.col("event_id").alias("app_seq"), "at", text("h", u % 20).alias("host"), text("u", k % 30).alias("url"), k.cast("string").alias("port"), (u % 7).alias("pid"),
        F.when(F.col("value") > 50, "Connect").otherwise("Disconnect").alias("state"), text("u", k % 30).alias("statement"),
    )
    nets = e.filter("rel in ('click', 'view')").select(
        F.col("event_id").alias("net_seq"), "at", text("h", u % 20).alias("__src"), text("h", k % 20).alias("__dst"), k.cast("string").alias("src_port"), u.cast("string").alias("dst_port"),
        F.when(F.col("value") > 50, "TCP").otherwise("HTTP").alias("protocol"), text("u", k % 30).alias("payload"), F.when(F.col("rel") == "view", text("f", k)).alias("file"),
    )
    return apps, nets.withColumnsRenamed({"__src": "src", "__dst": "dst"})


@query(_S + " SELECT net_seq, min(app_seq) AS app_seq FROM n JOIN a ON a.host = n.src OR a.host = n.dst GROUP BY net_seq")
def rule_mini_httpd(s, d):
    return rules.mini_httpd(*_both(s, d))


@query(
    _S + """ SELECT net_seq, max(app_seq) AS app_seq FROM n JOIN a ON CASE WHEN protocol = 'TCP' THEN (a.host = n.src AND a.port = n.src_port) OR (a.host = n.dst AND a.port = n.dst_port)
    ELSE a.host = n.src OR a.host = n.dst END GROUP BY net_seq"""
)
def rule_redis(s, d):
    return rules.redis(*_both(s, d))


@query(
    _S + """, p AS (SELECT net_seq, "at", src_port AS port FROM n UNION SELECT net_seq, "at", dst_port FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY "at", net_seq) AS up, row_number() OVER (PARTITION BY port ORDER BY "at" DESC, net_seq DESC) AS down FROM p)
    SELECT net_seq, min(app_seq) AS app_seq FROM r JOIN a USING (port) WHERE (state = 'Connect' AND up <= 3) OR (state = 'Disconnect' AND down <= 4) GROUP BY net_seq"""
)
def rule_openssh(s, d):
    return rules.openssh(*_both(s, d))


_PHP = _S + """, ra AS (SELECT *, row_number() OVER (PARTITION BY host, url ORDER BY "at", app_seq) AS k FROM a),
  rn AS (SELECT *, row_number() OVER (PARTITION BY src, payload ORDER BY "at", net_seq) AS k FROM y WHERE protocol <> 'TCP'),
  bound AS (SELECT rn.key, min(app_seq) AS app_seq FROM ra JOIN rn ON rn.src = ra.host AND rn.payload = ra.url AND rn.k = ra.k GROUP BY rn.key),
  php AS MATERIALIZED (SELECT net_seq, app_seq FROM y JOIN bound USING (key))"""


@query(_PHP + " SELECT * FROM php")
def rule_php(s, d):
    return rules.php(*_both(s, d))


@query(
    _PHP + """, fa AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "at", app_seq) AS k FROM a WHERE app_seq NOT IN (SELECT app_seq FROM php)),
    fn AS (SELECT src, key, min(("at", net_seq)) AS x FROM y WHERE protocol = 'TCP' AND net_seq NOT IN (SELECT net_seq FROM php) GROUP BY src, key),
    fr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY x) AS k FROM fn), forced AS (SELECT fr.key, min(app_seq) AS app_seq FROM fa JOIN fr ON fr.src = fa.host AND fr.k = fa.k GROUP BY fr.key)
    SELECT * FROM php UNION ALL SELECT net_seq, app_seq FROM y JOIN forced USING (key) WHERE net_seq NOT IN (SELECT net_seq FROM php)"""
)
def rule_nginx(s, d):
    return rules.nginx(*_both(s, d))


@query(
    _S + """, b AS (SELECT net_seq, min(app_seq) AS app_seq FROM n JOIN a ON a.port = n.src_port OR a.port = n.dst_port GROUP BY net_seq),
    l AS (SELECT n.net_seq, arg_min(app_seq, (a."at", app_seq)) AS app_seq FROM n JOIN a ON a.statement = n.payload AND a."at" >= n."at" WHERE n.net_seq NOT IN (SELECT net_seq FROM b) GROUP BY n.net_seq)
    SELECT * FROM b UNION ALL SELECT * FROM l"""
)
def rule_postgres(s, d):
    return rules.postgres(*_both(s, d))


@query(
    _S + """, p AS (SELECT host, pid, min(("at", app_seq)) AS x FROM a GROUP BY host, pid), q AS (SELECT host, x[2] AS app_seq, row_number() OVER (PARTITION BY host ORDER BY x) AS k FROM p),
    u AS (SELECT net_seq, src, row_number() OVER (PARTITION BY src ORDER BY "at", net_seq) AS k FROM n WHERE file IS NOT NULL) SELECT net_seq, app_seq FROM u JOIN q ON q.host = u.src AND q.k = u.k"""
)
def rule_imagemagick(s, d):
    return rules.imagemagick(*_both(s, d))


@query(_S + " SELECT net_seq, CAST(NULL AS BIGINT) AS app_seq FROM n")
def rule_vim(s, d):
    """Editors leave no network records: every record comes out without a label."""
    return rules.correlate("vim", *_both(s, d)).select("net_seq", "app_seq")


@query(
    _S + """, l AS (SELECT n.*, x.app_seq FROM n LEFT JOIN (SELECT net_seq, min(app_seq) AS app_seq FROM n JOIN a ON a.host = n.src OR a.host = n.dst GROUP BY net_seq) x USING (net_seq)),
    z AS (SELECT *, CASE WHEN protocol = 'HTTP' THEN payload END AS said FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY app_seq, src, dst, src_port, dst_port ORDER BY "at", net_seq) AS k FROM z)
    SELECT net_seq, app_seq FROM k WHERE k = 1 OR said IS NOT NULL"""
)
def rule_labels_compressed(s, d):
    apps, nets = _both(s, d)
    labelled = rules.correlate("mini_httpd", apps, nets).withColumn("payload", F.when(F.col("protocol") == "HTTP", F.col("payload")))
    return rules.compressed(labelled).select("net_seq", "app_seq")


@query(_S + " SELECT pid AS label, min(app_seq) AS app_seq FROM a WHERE pid > 0 GROUP BY pid")
def first_of_labels(s, d):
    apps, _ = _both(s, d)
    return rules.first_of_label(apps.withColumn("label", F.when(F.col("pid") > 0, F.col("pid"))))


@query(
    _S + """, w AS (SELECT min("at") AS lo, max("at") AS hi FROM n) SELECT count(*) AS n FROM (SELECT greatest(a."at", n."at") // 1000000 AS later, least(a."at", n."at") // 1000000 AS earlier FROM a, n WHERE a.host = n.src AND a.pid = 1) q
    WHERE later + 1 <= (SELECT hi // 1000000 FROM w) AND later - earlier <= 3600"""
)
def visible_together(s, d):
    """Pairs that a sliding buffer of an hour holds at one tick of a second."""
    apps, nets = _both(s, d)
    last = nets.agg(F.floor(F.max("at") / 1_000_000).alias("last"))
    pairs = apps.filter("pid = 1").select("host", F.floor(F.col("at") / 1_000_000).alias("a")).join(nets.select(F.col("src").alias("host"), F.floor(F.col("at") / 1_000_000).alias("b")), "host")
    seen = C.visible_together(F.col("a"), F.col("b"), F.lit(0), F.col("last"), 3600)
    return pairs.join(F.broadcast(last)).filter(seen).agg(F.count(F.lit(1)).alias("n"))


@query(
    _S + """, r AS (SELECT k AS pid, u AS ppid, CASE WHEN value > 30 THEN 'n' || u % 9 END AS name, event_id AS seq FROM e WHERE rel = 'signup'),
    n1 AS (SELECT pid, arg_min(name, seq) AS name FROM r WHERE name IS NOT NULL GROUP BY pid), up AS (SELECT pid, arg_min(ppid, seq) AS pp FROM r GROUP BY pid)
    SELECT r.seq, r.pid, coalesce(p.name, g.name) AS parent FROM r LEFT JOIN n1 p ON p.pid = r.ppid LEFT JOIN up ON up.pid = r.ppid LEFT JOIN n1 g ON g.pid = up.pp"""
)
def parent_names(s, d):
    e = T.edge_view(table(s, d, "events")).filter("rel = 'signup'")
    rows = e.select(F.col("dst").alias("pid"), F.col("src").alias("ppid"), F.when(F.col("value") > 30, F.concat(F.lit("n"), (F.col("src") % 9).cast("string"))).alias("name"), F.col("event_id").alias("seq"))
    return C.parent_names(rows).select("seq", "pid", "parent")

"""Queries of the general data-processing problems (1, 2, 4 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import bad_rows, log_lines, nested_json, timestamps
from tracewright.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    return log_lines.parse_entries(table(spark, d, "loglines"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested_json.label_nodes(table(spark, d, "packets"))
    return nodes.withColumn("members", F.to_json("members"))


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    stamps = table(spark, d, "logstamps").select("rec_id", "parser", "node_id", "stamp_raw", "recv_ts")
    return timestamps.resolve_instants(stamps, table(spark, d, "lognodes"))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.split_rows(table(spark, d, "accessrows"))[0]


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: log_lines.found_entries(table(s, d, "loglines")),
    "p1_entries": p1_entries,
    "p2_found": lambda s, d: nested_json.found_children(table(s, d, "packets")),
    "p2_nodes": p2_nodes,
    "p4_found": lambda s, d: timestamps.found_instants(table(s, d, "logstamps"), table(s, d, "lognodes")),
    "p4_instants": p4_instants,
    "p6_found": lambda s, d: bad_rows.found_failures(table(s, d, "accessrows")),
    "p6_loaded": p6_loaded,
}
def _failures_sql() -> str:
    """Failing rows by one pattern of a field instead of the column expressions."""
    from tracewright.plans.log_queries import _BARE, _WITH, _WITHOUT

    return f"""WITH q AS (SELECT DISTINCT row_id, feed <> 'ProftpdLog' AS access, raw FROM accessrows),
    w AS (SELECT *, CASE WHEN access THEN regexp_extract_all(raw, $re${_WITH}$re$) ELSE regexp_extract_all(raw, $re${_WITHOUT}$re$) END AS parts, regexp_replace(raw, $re$\\\\(?:.|\\n)$re$, '', 'g') AS plain FROM q),
    p AS (SELECT *, list_transform(parts, lambda x: {_BARE.format(x="x")}) AS f, len(plain) - len(replace(plain, '"', '')) AS quotes FROM w),
    v AS (SELECT *, CASE WHEN access THEN f[7] ELSE f[8] END AS size FROM p),
    r AS (SELECT row_id, CASE WHEN raw IS NULL OR regexp_matches(raw, $re$^[\\s\\x0b]*$$re$) THEN 'columns' WHEN quotes % 2 = 1 THEN 'quoting'
      WHEN (access AND len(f) NOT IN (7, 11)) OR (NOT access AND len(f) <> 18) THEN 'columns'
      WHEN (access AND NOT regexp_matches(f[6], '^[1-5][0-9][0-9]$')) OR NOT ((regexp_matches(size, '^[0-9]+$') AND TRY_CAST(size AS BIGINT) IS NOT NULL) OR (access AND size = '-'))
        OR (NOT access AND f[11] NOT IN ('_', 'c', 'i')) THEN 'value' END AS reason FROM v)
    SELECT row_id, reason FROM r WHERE reason IS NOT NULL"""


#: The others cannot be put as SQL over the raw texts at this size; tests hold them against plain Python versions.
SQL: dict[str, str] = {"p6_found": _failures_sql()}

"""Every core operator with nulls in all columns, empty texts, repeated rows and clashing extra columns."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracewright.operators import bad_rows, graph, log_lines, nested_json, ordering, timestamps, triples

TEXTS = [None, "", " ", "x", '"', "{", "[", "\\", "\x00", "é漢🙂", "a" * 20_000, "\n\r\t", "%s$1${x}", "2024-03-01 10:00:00"]


@pytest.mark.parametrize("extra", [[], ["line", "layout", "block", "level", "e", "f", "__p", "__tz", "utc_us_"]])
def test_texts_of_any_kind(spark, extra):
    keys = [None, 1, 1, 2]
    rows = [(k, i, i, t) for (k, t), i in zip(itertools.product(keys, TEXTS), itertools.count())]
    added = [F.lit("x").alias(c) for c in extra]
    lines = spark.createDataFrame(rows, "stream_id bigint, line_no bigint, line_id bigint, raw string").select("*", *added)
    assert log_lines.found_entries(lines).count() == 0
    packets = spark.createDataFrame([(r[1], r[0], r[3]) for r in rows], "pkt_id bigint, capture_id bigint, layers string").select("*", *added)
    assert nested_json.found_children(packets).count() == 0
    records = spark.createDataFrame([(r[1], "ApacheLog", r[3]) for r in rows], "row_id bigint, feed string, raw string").select("*", *added)
    assert bad_rows.found_failures(records).count() == len(rows)
    nodes = spark.createDataFrame([(1, "n", "UTC")], "node_id int, node_name string, tz_name string")
    stamps = spark.createDataFrame([(r[1], r[0], r[3], None) for r in rows], "rec_id bigint, node_id int, stamp_raw string, recv_ts timestamp")
    got = timestamps.found_instants(stamps.select("*", *added), nodes)
    assert got.count() == sum(r[0] == 1 and r[3] == TEXTS[-1] for r in rows)


def test_nulls_in_graph_columns(spark):
    rows = [(1, None, "b", "r", 1, 2), (2, "a", None, "r", 1, 2), (3, "a", "b", None, None, None), (4, "a", "b", "r", 5, 6), (4, "a", "b", "r", 5, 6)]
    edges = spark.createDataFrame(rows, "event_id bigint, src string, dst string, relation string, start bigint, `end` bigint").withColumn("g", F.lit(None).cast("int"))
    assert graph.cpr_merge(edges, ["g"], "event_id").count() >= 3
    assert graph.components(edges.withColumn("g", F.lit(1)), ["g"]).count() == 2
    assert graph.node_ids(edges, "g").count() == 2
    facts = spark.createDataFrame([(1, None, 2), (1, 0, 2), (None, 0, 2), (1, 0, 2)], "h bigint, r bigint, t bigint")
    assert triples.relation_cardinality(facts).count() >= 1 and triples.golden_answers(facts).count() >= 3
    assert triples.bernoulli_stats(facts.limit(0)).count() == 0 and triples.entity_frequency(facts.limit(0)).count() == 0
    assert ordering.carry_forward(facts, ["h"], ["t"], F.col("r"), "x").count() == 4

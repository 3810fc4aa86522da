"""Queries whose pairs outnumber their rows: what is shuffled grows with the rows, and the result is that of the SQL."""

import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

HOUR = 3_600_000_000


def shuffled(spark, act):
    """What ``act`` returns, and how many rows its stages wrote to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        seen = context.statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (seen.apply(k) for k in range(seen.size()))}

    before = stages()
    got = act()
    return got, sum(n for k, n in stages().items() if k not in before)


def checked(spark, folder, query, rows):
    """How many rows are shuffled for one row of events, the result being that of the SQL."""
    frame = pd.DataFrame(rows, columns=["event_id", "us", "user_id", "event_type", "value", "k"])
    base = duckdb.connect()
    base.execute(f"""CREATE TABLE events AS SELECT event_id, make_timestamp(1704067200000000 + us) AS ts, user_id, event_type, value, '{{"k": ' || k || '}}' AS props FROM frame""")
    base.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    want = base.execute(entry.oracle_sql()[query]).fetchall()
    got, n = shuffled(spark, lambda: entry.queries()[query](spark, str(folder)).collect())
    assert sorted(tuple(r) for r in got) == sorted(want) and want
    return n / len(rows)


def crowd(n):
    """Clicks and purchases within half an hour, each a candidate of most others, and views of the same users at any time of a day."""
    rows = []
    for i in range(n):
        rows.append((4 * i, i * 7_919_000_003 % (HOUR // 2), i % 37, "click", 1.0, i % 100))
        rows.append((4 * i + 1, i * 6_700_417_001 % (HOUR // 2), i % 41, "purchase", i % 90 + 0.5, i * 7 % 100))
        rows.append((4 * i + 2, i * 9_576_890_767 % (HOUR // 2), i % 41, "view", 1.0, i * 11 % 100))
        rows.append((4 * i + 3, i * 9_576_890_767 % (24 * HOUR), i % 97, "view", 1.0, i % 100))
    return rows


@pytest.mark.parametrize("query", ["best_label_one_app", "best_label_two_apps"])
def test_best_labels_shuffle_no_pairs(spark, tmp_path, query):
    assert checked(spark, tmp_path, query, crowd(400)) < 5


def test_subset_graphs_shuffle_no_pairs_of_graphs(spark, tmp_path):
    """Many graphs of a day with the same few pairs: nearly each holds the rarest pair of most others."""
    kinds, rows = ["click", "view", "purchase"], []
    for user in range(600):
        for j in range(1 + user * 13 % 3):
            rows.append((len(rows), (user * 31 + j) % 3_600 * 1_000_000, user, kinds[(user * 7 + j) % 3], 1.0, user % 5 % 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert checked(spark, tmp_path, "subset_graph_prune", rows) < 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_subset_graphs_nulls_own_pairs_and_order(spark):
    from tracewright.operators import graph as G

    # 1 {a, b}; 2 {a}; 3 {a, null}; 4 {a, c, d}; 5 {c, d}; 6 {b, c}; 7 {c, d} again; 8 {c} with a null; 9 {e}, of its own; 10 {a, b, c}; 11 {null}
    held = {1: "ab", 2: "a", 3: "a-", 4: "acd", 5: "cd", 6: "bc", 7: "cd", 8: "c-", 9: "e", 10: "abc", 11: "-"}
    rows = [(0, g, None if p == "-" else p, 1) for g, ps in held.items() for p in ps] + [(1, 3, "a", 1), (1, 5, "a", 1), (None, 6, "a", 1), (0, None, "a", 1), (0, 2, "a", 1)]
    edges = spark.createDataFrame(rows, "day int, graph int, src string, dst int")
    assert sorted(tuple(r) for r in G.subset_graphs(edges, "graph", ["day"]).collect()) == [(0, 2), (0, 5), (0, 7), (1, 5)]

import random
from datetime import datetime, timedelta, timezone

from tracewright.llm import runs

SCHEMA = "edge_key bigint, graph_id bigint, subject_name string, object_name string, object_type string, log_type string, event_ts timestamp, ingested_at timestamp"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def edge(key, seconds, subject="p", obj="/a", kind="File", call="sys_read", graph=1):
    at = None if seconds is None else T0 + timedelta(seconds=seconds)
    return (key, graph, subject, obj, kind, call, at, T0)


def found(spark, rows):
    return sorted(map(tuple, runs.found_runs(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_ways_of_writing_and_separators(spark):
    rows = [
        edge(5, 0), edge(3, 10, " 'p' ", "/x/../a", call=" READ"), edge(4, 70, obj="//./a"), edge(6, 130.000001),
        edge(10, 200, obj="::FFFF:10.0.0.1/80", kind="Socket"), edge(11, 210, obj=" [::ffff:10.0.0.1]:80", kind="Socket"),
        edge(12, 300, None), edge(13, 301, None), edge(14, 400), edge(15, 401, call=None), edge(16, 402),
        edge(20, 500, "P"), edge(21, 501, "p"), edge(22, 600, obj=None, kind="Socket"), edge(23, 601, obj=None, kind="Socket"),
        edge(30, None), edge(31, 700, graph=2), edge(32, 700, graph=2), edge(33, 700, graph=2), edge(40, 705, graph=None),
        edge(50, 800, obj="a", kind="Process"), edge(51, 801, obj="A", kind="Process"), edge(52, 900, " "), edge(53, 900, " "),
    ]
    extra = spark.createDataFrame(rows + rows[:6], SCHEMA).selectExpr("*", "1 as us", "2 as root", "3 as pred")
    assert sorted(map(tuple, runs.found_runs(extra).collect())) == [(3, 5), (10, 11), (31, 33)]
    full = {r.lo_edge_key: r for r in runs.collapse_runs(extra).collect()}
    assert full[3].n_edges == 3 and full[3].duration_us == 70_000_000 and full[14].n_edges == 1


def test_empty_and_no_runs(spark):
    assert found(spark, []) == [] and found(spark, [edge(1, 0)]) == []


def test_random_streams_and_long_runs_against_a_loop(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    keys = list(range(1500))
    rng.shuffle(keys)
    for key in keys:
        t += rng.choice([0, 0, 1, 30, 59.9999, 60, 61, 3000])
        rows.append(edge(key, t, rng.choice("pppq"), graph=rng.choice([1, 1, 2])))
    rows += [edge(10_000 + k, 1e7 + k * 0.5, graph=3) for k in range(3000)]
    expected, last = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[6], r[0])):
        run = last.get(r[1])
        if run and run[-1][2] == r[2] and r[6] - run[-1][6] <= timedelta(seconds=60):
            run.append(r)
        else:
            last[r[1]] = [r]
            expected.append(last[r[1]])
    expected = sorted((min(r[0] for r in run), max(r[0] for r in run)) for run in expected if len(run) > 1)
    rng.shuffle(rows)
    assert found(spark, rows) == expected


def test_runs_over_batches_and_partitions(spark):
    rng = random.Random(5)
    rows, expected, key = [], [], 0
    for k in range(60):
        size = rng.choice([1, 1, 2, 3, 40, 333])
        run = [edge(key + i, k * 10_000 + i, subject=f"p{k % 3}", graph=1 + k // 40) for i in range(size)]
        key += size
        rows += run + run[:1]
        if size > 1:
            expected.append((run[0][0], run[-1][0]))
    rows += [edge(100_000 + k, 0, graph=9) for k in range(50)]  # equal times in one graph
    expected.append((100_000, 100_049))
    rng.shuffle(rows)
    options = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in options}
    try:
        for name, value in options.items():
            spark.conf.set(name, value)
        assert found(spark, rows) == sorted(expected)
        runs_ = {r.lo_edge_key: r for r in runs.collapse_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(runs_[lo].n_edges == hi - lo + 1 for lo, hi in expected)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_pointers_double():
    import numpy as np

    assert runs.double_within(np.array([0, 0, 1, 2, 4, 4, 5])).tolist() == [0, 0, 0, 0, 4, 4, 4]
    assert runs.double_within(np.maximum(np.arange(10_000) - 1, 0)).max() == 0

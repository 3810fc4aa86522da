import random
from datetime import datetime, timezone

from tracewright.llm import nearest_time as NT

POINTS, QUERIES = "entity bigint, us bigint, id bigint", "entity bigint, query_id bigint, us bigint, sub_ns bigint"


def brute(queries, points, tolerance):
    out = {}
    for entity, query, us, ns in queries:
        near = [(abs(us * 1000 + ns - p * 1000), p, i) for e, p, i in points if e == entity]
        near = [c for c in near if c[0] <= tolerance * 1000]
        if near:
            out[query] = min(near)[2]
    return out


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    for bits, span, tolerance in ((4, 200, 16), (6, 300, 20), (21, 40_000_000, 2_000_000)):
        points = [(rng.choice([1, 1, 2]), rng.randrange(span), 1000 + k) for k in range(150)]
        points += points[:20] + [(e, us, i + 500) for e, us, i in points[:20]]
        queries = [(rng.choice([1, 2, 3]), k, rng.randrange(span), rng.choice([0, 0, 500])) for k in range(300)]
        got = NT.nearest(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(points, POINTS), tolerance, bits)
        assert {r.query_id: r.id for r in got.collect() if r.id is not None} == brute(queries, points, tolerance)


def test_tables_as_written(spark):
    at = datetime(2022, 1, 1, tzinfo=timezone.utc)
    base = int(at.timestamp())
    net = [
        (1, f"{base}.5", "10.0.0.1", "40"), (2, f" {base + 2}.000000000", "::ffff:10.0.0.1 ", "040.0"), (3, f"{base + 3}", "10.0.0.1", "40"),
        (4, None, "10.0.0.1", "40"), (5, "1.2.3", "10.0.0.1", "40"), (6, f"{base}", None, "40"), (7, f"{base}", "10.0.0.1", "port"),
        (8, f"{base}", "10.0.0.2", "40"), (1, f"{base}.5", "10.0.0.1", "40"),
    ]
    app = [(101, at, " 10.0.0.1", '7"'), (100, at, "10.0.0.1", "[7]"), (102, None, "10.0.0.1", "7"), (103, at, "10.0.0.1", None)]
    workers = spark.createDataFrame([(1, "10.0.0.1", 7, 40)], "worker_id int, node_ip string, pid int, s_port int")
    netlogs = spark.createDataFrame(net, "net_id bigint, net_time string, s_ip string, s_port string").selectExpr("*", "1 as us", "1 as root")
    apachelogs = spark.createDataFrame(app, "app_id bigint, app_time timestamp, dst_ip string, pid string").selectExpr("*", "1 as entity")
    got = sorted(map(tuple, NT.found_pairs(netlogs, apachelogs, workers).collect()))
    assert got == [(1, 100), (2, 100)]
    assert NT.found_pairs(netlogs.limit(0), apachelogs, workers).count() == 0
    assert NT.found_pairs(netlogs, apachelogs.limit(0), workers).count() == 0

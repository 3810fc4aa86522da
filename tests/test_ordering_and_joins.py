import random

from pyspark.sql import functions as F

from tracewright.operators import correlate as C
from tracewright.operators import ordering as O
from tracewright.operators import triples as T


def test_global_numbers_and_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 50), rng.choice([None, 1, 2, 5])) for k in range(2000)]
    frame = spark.createDataFrame(rows, "k bigint, a bigint, v bigint").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    numbers = {r.k: r.number for r in O.global_numbers(frame, ["a", "k"]).collect()}
    assert numbers == {r[0]: i for i, r in enumerate(order)}
    sums, total = {}, 0
    for r in order:
        total += r[2] or 0
        sums[r[0]] = total
    assert {r.k: r.running for r in O.global_running_sum(frame, "v", ["a", "k"]).collect()} == sums
    assert O.global_numbers(frame.limit(0), ["a", "k"]).count() == 0


def test_boundary_queue(spark):
    rows = spark.createDataFrame([(1, k, k in (2, 4)) for k in range(1, 6)] + [(2, 1, True), (2, 2, True)], "key int, seq int, hit boolean")
    queues = spark.createDataFrame([(1, [4, 7]), (2, [9])], "key int, labels array<int>")
    got = {(r.key, r.seq): r.override for r in O.boundary_relabel(rows, queues, "key", ["seq"], F.col("hit")).collect()}
    assert [got[1, k] for k in range(1, 6)] == [None, 4, 4, 7, 7] and got[2, 1] == 9 and got[2, 2] is None


def test_islands_treat_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (2, 1, "a")], "g int, s int, v string")
    got = {(r.g, r.s): r.island for r in O.islands(rows, ["g"], ["s"], ["v"]).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (2, 1): 0}
    kept = O.drop_repeats(rows, ["g"], ["s"], ["v"]).collect()
    assert sorted((r.g, r.s) for r in kept) == [(1, 1), (1, 3), (2, 1)]


def test_range_and_asof_joins_against_loops(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), k, rng.randint(0, 400)) for k in range(120)]
    right = [(rng.choice("ab"), 1000 + k, rng.randint(0, 400)) for k in range(120)]
    a = spark.createDataFrame(left, "g string, i bigint, t bigint")
    b = spark.createDataFrame(right, "g string, j bigint, u bigint")
    got = sorted((r.i, r.j) for r in C.range_join(a, b, ["g"], "t", "u", -7, 13).collect())
    assert got == sorted((i, j) for g, i, t in left for h, j, u in right if g == h and t - 7 <= u <= t + 13)
    best = {r.i: r.j for r in C.best_score_join(a, b, ["g"], "i", "t", "j", "u", 20).collect()}
    brute = {}
    for g, i, t in left:
        near = [(abs(t - u), j) for h, j, u in right if g == h and abs(t - u) <= 20]
        if near:
            brute[i] = min(near)[1]
    assert best == brute
    after = {r.i: r.j for r in C.asof_forward(a, b, ["g"], "i", "t", "j", "u").collect()}
    assert after == {i: min(((u, j) for h, j, u in right if h == g and u >= t), default=(0, None))[1] for g, i, t in left}


def test_weights_of_the_small_example(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "g int, x string")
    got = {r.x: r for r in T.term_frequency(rows, "g", ["x"]).collect()}
    assert got["a"].tf == 1 and abs(got["b"].tf - 2 / 3) < 1e-12 and got["a"].idf == 0
    assert abs(got["b"].idf - 0.124939) < 1e-6 and abs(got["b"].tfidf - 0.083292) < 1e-6
    assert [r.weight for r in T.uniform_weight(rows, ["x"]).collect()] == [0.5, 0.5]
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 4.0])], "x string, vec array<double>")
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "x string, tfidf double")
    assert {r.g: r.vec for r in T.graph_vectors(rows, vectors, weights, "g", ["x"]).collect()} == {1: [1.0, 4.0], 2: [1.0, 4.0], 3: [1.0, 2.0]}


def test_snapshots_partition_the_facts(spark):
    facts = spark.createDataFrame([(k % 13, k % 3, k % 17) for k in range(200)], "h bigint, r bigint, t bigint")
    cut = T.frontier_snapshots(facts, 20)
    assert cut.count() == facts.distinct().count() and cut.select("h", "r", "t").distinct().count() == cut.count()
    sizes = {r.snapshot: r["count"] for r in cut.groupBy("snapshot").count().collect()}
    assert sizes[0] == 20 and max(sizes.values()) >= 20


def test_parents(spark):
    rows = spark.createDataFrame([(1, 0, "init", 1), (2, 1, None, 2), (3, 2, "sh", 3), (4, 3, "ls", 4)], "pid int, ppid int, name string, seq int")
    assert {r.pid: r.parent for r in C.parent_names(rows).collect()} == {1: None, 2: "init", 3: "init", 4: "sh"}

import random

from pyspark.sql import functions as F

from tracewright.operators import graph as G

EDGES = "event_id bigint, g int, src string, dst string, relation string, start bigint, `end` bigint"


def sequential_cpr(edges):
    """The same reduction as an ordered fold over each pair, checked against all edges."""
    kept = {}
    stacks = {}
    for e in sorted(edges, key=lambda e: (e[5], e[6], e[0])):
        i, g, u, v, rel, start, end = e
        top = stacks.get((g, u, v, rel))
        if top is not None:
            ps, pe = top[3], top[1]
            out = any(x[1] == g and x[2] == v and x[6] >= ps and x[5] <= start for x in edges)
            into = any(x[1] == g and x[3] == u and x[6] >= pe and x[5] <= end for x in edges)
            if not out and not into:
                top[1], top[2], top[3] = end, top[2] + 1, start
                continue
        stacks[g, u, v, rel] = kept[i] = [start, end, 1, start]
    return {i: (a, b, n) for i, (a, b, n, _) in kept.items()}


def test_cpr_against_a_fold(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        start = rng.randint(0, 3000)
        rows.append((k, rng.choice([1, 2]), rng.choice("abcd"), rng.choice("abcd"), rng.choice("rw"), start, start + 10))
    merged = G.cpr_merge(spark.createDataFrame(rows, EDGES), ["g"], "event_id").collect()
    assert {r.event_id: (r.start, r.end, r.n_edges) for r in merged} == sequential_cpr(rows)


def test_head_anchored_against_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), k, rng.randint(0, 300), rng.sample(["x", "y", "z"], rng.randint(0, 2))) for k in range(400)]
    frame = spark.createDataFrame(rows, "key string, id bigint, start bigint, values array<string>")
    kept, head = [], {}
    for key, i, start, values in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        old = head.get(key)
        joint = set(values) | (old[1] if old else set())
        alike = 1.0 if not joint else len(set(values) & (old[1] if old else set())) / len(joint)
        if old is None or start - old[0] > 10 or alike <= 0.95:
            head[key] = (start, set(values))
            kept.append(i)
    assert sorted(r.id for r in G.head_anchored(frame, ["key"], "id").collect()) == sorted(kept)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    rows = [(g, f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for g in (1, 2) for _ in range(70)]
    rows += [(3, f"p{k:04d}", f"p{k + 1:04d}") for k in range(300)] + [(4, "x", "x"), (5, None, "y")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in rows:
        if a and b:
            a, b = sorted((find((g, a)), find((g, b))))
            parent[b] = a
    got = {(r.g, r.node): r.component for r in G.components(spark.createDataFrame(rows, "g int, src string, dst string"), ["g"]).collect()}
    least = {}
    for g, n in list(parent):
        least.setdefault(find((g, n)), []).append(n)
    assert got == {(g, n): min(least[find((g, n))]) for g, n in parent}


def test_reach_in_time_with_several_hops(spark):
    rows = [("a", "b", 1), ("b", "c", 2), ("c", "d", 2), ("c", "e", 3), ("b", "c", 1), ("e", "a", 9)]
    edges = spark.createDataFrame([(1, *r) for r in rows], "g int, src string, dst string, at bigint")
    starts = spark.createDataFrame([(1, "a")], "g int, start string")
    got = {r.node: (r.at, r.hop) for r in G.reach_in_time(edges, starts, 4, ["g"]).collect()}
    assert got == {"b": (1, 1), "c": (2, 2), "e": (3, 3), "a": (9, 4)}
    assert G.reach_in_time(edges, starts, 3, ["g"], cap=1).count() == 1


def test_noise_and_overlap(spark):
    rows = spark.createDataFrame([(None,), ("",), ("/",), ("/proc/1",), ("/a b",), ("/home/x",)], "n string")
    assert [r[0] for r in rows.filter(~G.is_noise(F.col("n"))).collect()] == ["/proc/1", "/home/x"]
    one = spark.range(1).select(G.overlapping(F.lit(10), F.lit(20), F.lit(20), F.lit(30)).alias("x"), G.overlapping(F.lit(10), F.lit(20), F.lit(21), F.lit(30)).alias("y"))
    assert tuple(one.first()) == (True, False)
    edges = spark.createDataFrame([(1, "net", {"port": "1", "protocol": "HTTP"}), (2, "net", {"protocol": "HTTP"}), (3, "net", {"port": "1", "protocol": "dns"}), (4, "app", {})], "i int, data_source string, log_data map<string,string>")
    assert sorted(r.i for r in G.drop_net_noise(edges).collect()) == [1, 4]


def test_bridges_claims_and_ends(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (1, "e", "f")], "g int, src string, dst string")
    bridges = G.component_bridges(G.components(edges, ["g"]), ["g"]).collect()
    assert sorted((r.src, r.dst) for r in bridges) == [("c", "a"), ("e", "a")]
    rows = [(1, "a", "b", 1, 5, 10), (1, "a", "b", 2, 5, 20), (1, "a", "b", 3, None, 15), (1, "a", "b", 4, None, 25)]
    claimed = G.claim_parallel(spark.createDataFrame(rows, "g int, src string, dst string, id int, label int, start int"), ["g"], "id")
    assert {r.id: r.label for r in claimed.collect()} == {1: 5, 2: 5, 3: 5, 4: None}
    audit = spark.createDataFrame([("p", "/f", None, None, None, "sys_write", 1), ("p", None, "1.2.3.4", 80, None, "sys_read", 2), ("p", None, None, None, "q", "sys_clone", 3), ("p", None, None, None, None, "sys_exit", 4)], "process_name string, file string, ip string, port int, child string, action string, ts_us bigint")
    built = G.build_edges(audit, ["sys_read"]).orderBy("ts_us").collect()
    assert [(r.src, r.dst, r.dst_type) for r in built] == [("p", "/f", "File"), ("1.2.3.4:80", "p", "Process"), ("p", "q", "Process")]


def test_reachability_of_every_relation(spark, tmp_path):
    from tracewright.plans import catalogue

    rows = [(1, 1, "click", 2, 0), (2, 2, "click", 3, 5), (3, 1, "view", 2, 7), (4, 2, "view", 4, 9), (5, 2, "view", 5, 6)]
    events = spark.createDataFrame([(i, u, r, 0.0, '{"k": %d}' % k, at) for i, u, r, k, at in rows], "event_id bigint, user_id bigint, event_type string, value double, props string, at bigint")
    events.selectExpr("* except (at)", "timestamp_micros(at) as ts").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.rel, r.start, r.node): (r["at"], r.hop) for r in catalogue.temporal_reachability_2hop(spark, str(tmp_path)).collect()}
    assert got == {
        ("click", 1, 2): (0, 1), ("click", 2, 3): (5, 1), ("click", 1, 3): (5, 2),
        ("view", 1, 2): (7, 1), ("view", 2, 4): (9, 1), ("view", 2, 5): (6, 1), ("view", 1, 4): (9, 2),
    }


def test_cpr_at_a_hub_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    rows = []
    for k in range(400):
        # Half of the edges leave one node, most of them to one other; timelines are cut into slices of so many rows.
        src, dst = ("hub", rng.choice(["x", "x", "x", "y", None])) if k % 2 else (rng.choice("xyz"), rng.choice(["hub", "y", "z"]))
        start = rng.randrange(0, 5000)
        rows.append((1, k, src, dst, rng.choice(["r", None]), start, start + rng.choice([0, 5, 40])))
    frame = spark.createDataFrame(rows, "g int, id int, src string, dst string, relation string, start bigint, `end` bigint")
    groups, last = {}, {}
    for g, i, src, dst, rel, start, end in sorted(rows, key=lambda r: (r[5], r[6], r[1])):
        before = last.get((src, dst, rel))
        last[src, dst, rel] = (start, end)
        over = lambda a, b, low, high: not (b < low or a > high)
        flows = before is None or any(r[2] == dst and dst is not None and over(r[5], r[6], before[0], start) for r in rows) or any(
            r[3] == src and src is not None and over(r[5], r[6], before[1], end) for r in rows
        )
        flows = flows or (dst is None and any(r[2] is None and over(r[5], r[6], before[0], start) for r in rows))
        if flows:
            groups.setdefault((src, dst, rel), []).append([])
        groups[src, dst, rel][-1].append((i, start, end))
    expected = sorted((str(k), run[0][0], min(x[1] for x in run), max(x[2] for x in run), len(run)) for k, runs in groups.items() for run in runs)
    for width in (5, 90, 1_000_000):
        got = G.cpr_merge(frame, ["g"], "id", width).collect()
        assert sorted((str((r.src, r.dst, r.relation)), r.id, r.start, r.end, r.n_edges) for r in got) == expected, width

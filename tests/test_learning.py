import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import clusters as K
from tracewright.operators import encoders as N
from tracewright.operators import ranking as R
from tracewright.operators import training as L
from tracewright.operators import vectors as V


def vectors(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, k % 3, (rng.normal(0, 0.3, 4) + 3 * (k % 3)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, vec array<double>"), rows


def test_training_lowers_the_loss_and_is_saved(spark):
    rng = random.Random(1)
    facts = spark.createDataFrame([(k, rng.randint(0, 2), (k * 7 + 1) % 40) for k in range(40)] * 3, "h bigint, r bigint, t bigint")
    model = L.train_static(facts, 40, 3, L.Settings(dim=16, margin=1.0, rate=0.5, epochs=8, batch=64))
    losses = model.log[0]["losses"]
    assert losses[-1] < losses[0]
    again = L.model_from(L.model_tables(spark, model))
    assert np.allclose(again.ent, model.ent) and np.allclose(again.rel, model.rel)
    report = L.evaluate(model, facts.limit(20), facts).first()
    assert report.n > 0 and 0 < report.mrr <= 1


def test_every_strategy_runs_over_snapshots(spark):
    one = spark.createDataFrame([(k, k % 2, (k + 1) % 10) for k in range(10)], "h bigint, r bigint, t bigint")
    two = spark.createDataFrame([(k, k % 3, (k + 3) % 14) for k in range(14)], "h bigint, r bigint, t bigint")
    settings = L.Settings(dim=8, margin=1.0, rate=0.1, epochs=1, batch=32, negatives=2, memory=6)
    first = L.continual([one], [(10, 2)], "finetune", settings)
    for strategy in L.STRATEGIES:
        model = L.continual([one, two], [(10, 2), (14, 3)], strategy, settings)
        assert model.ent.shape == (14, 8) and np.isfinite(model.ent).all() and len(model.log) == 2
        if strategy == "pnn":
            assert np.allclose(model.ent[:10] / np.maximum(np.linalg.norm(model.ent[:10], axis=1, keepdims=True), 1), first.ent)
    assert L.transfer_report([0.4, 0.5], [0.1, 0.2], [0.3, 0.5])["bwt"] < 0


def test_ranks_against_numpy(spark):
    frame, rows = vectors(spark)
    x = np.array([r[2] for r in rows])
    asked = [(k, (x[k] + 0.1).tolist(), (k * 5 + 2) % 60) for k in range(0, 60, 7)]
    queries = spark.createDataFrame(asked, "query_id bigint, query array<double>, target bigint")
    known = spark.createDataFrame([(k, (k * 5 + 3) % 60) for k, _, _ in asked], "query_id bigint, id bigint")
    got = {r.query_id: (r["rank"], r.filtered_rank) for r in R.ranks(queries, frame, known, block=4).collect()}
    for k, q, t in asked:
        d = np.abs(x - np.array(q)).sum(1)
        rank = 1 + int((d < d[t]).sum())
        assert got[k] == (rank, rank - int(d[(k * 5 + 3) % 60] < d[t]))


def test_scores_with_matrices(spark):
    rng = np.random.default_rng(3)
    h, r, t, m = rng.normal(size=4), rng.normal(size=4), rng.normal(size=4), rng.normal(size=16)
    hp, rp, tp = rng.normal(size=4), rng.normal(size=4), rng.normal(size=4)
    row = tuple(v.tolist() for v in (h, r, t, m, hp, rp, tp))
    frame = spark.createDataFrame([row], ", ".join(f"{c} array<double>" for c in ("h", "r", "t", "m", "hp", "rp", "tp")))
    c = F.col
    got = frame.select(
        V.transr(c("h"), c("r"), c("t"), c("m")).alias("transr"), V.rescal(c("h"), c("m"), c("t")).alias("rescal"), V.hole(c("h"), c("r"), c("t")).alias("hole"),
        V.transd(c("h"), c("r"), c("t"), c("hp"), c("rp"), c("tp")).alias("transd"), V.analogy(c("h"), c("r"), c("t"), c("hp"), c("rp"), c("tp")).alias("analogy"),
        V.complex_score(c("h"), c("r"), c("t")).alias("complex"), V.padded(c("h"), 6).alias("pad"), V.cosine(c("h"), c("t")).alias("cos"),
    ).first()
    unit = lambda x: x / np.linalg.norm(x)
    mm = m.reshape(4, 4)
    assert np.isclose(got.transr, np.abs(unit(h @ mm) + unit(r) - unit(t @ mm)).sum())
    assert np.isclose(got.rescal, -h @ mm @ t)
    assert np.isclose(got.hole, sum(r[k] * sum(h[i] * t[(k + i) % 4] for i in range(4)) for k in range(4)))
    project = lambda e, ep: unit(e + (e @ ep) * rp)
    assert np.isclose(got.transd, np.abs(project(h, hp) + unit(r) - project(t, tp)).sum())
    z = lambda v: v[:2] + 1j * v[2:]
    real = (z(h) * z(r) * np.conj(z(t))).sum().real
    assert np.isclose(got.complex, real) and np.isclose(got.analogy, -real - (hp * rp * tp).sum())
    assert got.pad == [*h.tolist(), 0.0, 0.0] and np.isclose(got.cos, unit(h) @ unit(t))


def test_dbscan_and_kmeans_find_the_groups(spark):
    frame, rows = vectors(spark)
    found = {r.id: r.cluster for r in K.dbscan(frame, "id", 2.0, 3).collect()}
    assert len({found[r[0]] for r in rows}) == 3 and all(found[r[0]] == found[r[1]] for r in rows)
    means = {r.id: r.label for r in K.kmeans(frame, K.centroids(frame, "label"), "id", "label", 5).collect()}
    assert all(means[r[0]] == r[1] for r in rows)
    assert K.dbscan(frame.limit(0), "id", 2.0, 3).count() == 0


def test_denstream_against_a_plain_fold(spark):
    frame, rows = vectors(spark, 90)
    got = sorted((round(r.weight, 6), [round(x, 6) for x in r.centre]) for r in K.denstream(frame.withColumn("g", F.lit(1)), ["g"], ["id"], 1.0, 0.5, 3.0, 0.01).collect())
    plain = K.MicroClusters(1.0, 0.5, 3.0, 0.01)
    for _, _, vec in rows:
        plain.add(np.array(vec))
    assert got == sorted((round(c[2], 6), [round(float(x), 6) for x in c[0]]) for c in plain.kept) and len(got) == 3


def test_denstream_labels(spark):
    frame, rows = vectors(spark, 90)
    stream = frame.withColumn("g", F.lit(1))
    folded = K.denstream(stream, ["g"], ["id"], 1.0, 0.5, 3.0, 0.01)
    labels = {r.id: r.cluster for r in K.denstream_labels(stream, ["g"], "id", folded).collect()}
    assert len({labels[r[0]] for r in rows}) == 3 and all(labels[r[0]] == labels[r[1]] for r in rows)
    other = K.denstream_labels(frame.withColumn("g", F.lit(2)), ["g"], "id", folded)
    assert {r.cluster for r in other.collect()} == {None}


def test_average_linkage_against_nearest_pairs():
    rng = np.random.default_rng(3)
    for _ in range(10):
        x, k = rng.normal(size=(20, 3)), int(rng.integers(1, 6))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(len(x))]
        while len(groups) > k:
            _, i, j = min(((1 - u @ u.T)[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            groups[i] += groups.pop(j)
        own = {i: g for g, members in enumerate(groups) for i in members}
        assert len({(a, own[i]) for i, a in enumerate(N.agglomerate(x, k))}) == k


def test_batches_do_not_depend_on_partitions(spark):
    pairs = spark.createDataFrame([(k, [1.0, float(k)], [1.0, float(k) + 0.1]) for k in range(20)], "k int, a array<double>, b array<double>")
    one, two = (sorted((r.k, round(r.loss, 9)) for r in N.contrastive_by_batch(pairs.repartition(n), "k", 6).collect()) for n in (1, 5))
    assert one == two and len(one) == 20


def test_a_large_graph_is_searched_too():
    n = 3000
    links = {k: {x for x in (k - 1, k + 1) if 0 <= x < n} for k in range(n)}
    atoms, score = N.search_subgraph({k: np.array([1.0]) for k in range(n)}, links, np.array([5.0]), 10, rounds=1, branches=1)
    assert 0 < len(atoms) and score > 0


def test_encoders(spark):
    nodes = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(4)], "g int, node bigint, vec array<double>")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "g int, src bigint, dst bigint")
    weight, bias = np.array([[1.0], [1.0]]), np.array([0.0])
    out = N.encode_graphs(nodes, edges, ["g"], [(weight, bias)]).first().vec
    near = [[0 + 1, 2], [0 + 1 + 2, 3], [1 + 2, 2], [3, 1]]
    assert out == [float(sum(map(sum, near)))]
    atoms, score = N.search_subgraph({k: np.array([float(k)]) for k in range(6)}, {k: {k - 1, k + 1} & set(range(6)) for k in range(6)}, np.array([9.0]), 2)
    assert sorted(atoms) == [4, 5] and score > 0
    assert len(set(N.agglomerate(np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1]]), 2))) == 2
    pairs = spark.createDataFrame([(k, [1.0, float(k)], [1.0, float(k) + 0.1]) for k in range(6)], "k int, a array<double>, b array<double>")
    assert N.contrastive_by_batch(pairs, "k", 3).count() == 6
    assert N.explain_graphs(nodes, edges, "g", np.array([9.0, 3.0]), 2).count() == 1
    assert N.agglomerative(nodes, ["g"], "node", 2).select("cluster").distinct().count() == 2
    assert N.class_connections([0, 1], 2).tolist() == [[1, -0.5], [-0.5, 1]]


def test_clustream_keeps_few_clusters(spark):
    frame, rows = vectors(spark, 120)
    micro = K.clustream(frame.withColumn("g", F.lit(1)), ["g"], ["id"], m=10, horizon=400)
    got = micro.collect()
    assert 3 <= len(got) <= 10 and sum(r.weight for r in got) == 120
    centres = np.array([r.vec for r in got])
    assert all(np.abs(centres - 3 * k).max(1).min() < 1 for k in range(3))


def test_optimisers_against_their_formulas():
    g, x0 = np.array([[0.5, -2.0]]), np.array([[1.0, 1.0]])
    expected = {
        "sgd": x0 - 0.1 * g, "adagrad": x0 - 0.1 * g / (np.abs(g) + 1e-10), "adam": x0 - 0.1 * g / (np.abs(g) + 1e-8),
        "adadelta": x0 - 0.1 * np.sqrt(1e-6) / np.sqrt(0.1 * g * g + 1e-6) * g,
    }
    for name, after in expected.items():
        x = x0.copy()
        L.Optimiser(name, 0.1, [np.zeros_like(x) for _ in range(L.Optimiser.STATES[name])]).step(x, g)
        assert np.allclose(x, after), name


def test_every_optimiser_lowers_the_loss(spark):
    facts = spark.createDataFrame([(k % 40, k % 3, (k * 7 + k % 3) % 40) for k in range(400)], "h bigint, r bigint, t bigint")
    for name, rate in (("adagrad", 0.1), ("adam", 0.01), ("adadelta", 1.0)):
        losses = L.train_static(facts, 40, 3, L.Settings(dim=8, margin=1.0, rate=rate, epochs=4, batch=64, optimiser=name)).log[0]["losses"]
        assert min(losses[1:]) < losses[0], name


def test_projection_is_the_least_change_that_agrees():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, m = rng.normal(size=6), rng.normal(size=6)
        out = L.projected(g, m)
        if g @ m >= 0:
            assert (out == g).all()
            continue
        p, q = np.array([[m @ m, m @ g], [m @ g, g @ g]]) + np.eye(2) * 1e-3, np.array([m @ g, g @ g])
        grid = np.linspace(0.5, 8, 400)
        a, b = np.meshgrid(grid, grid)
        value = (p[0, 0] * a * a + 2 * p[0, 1] * a * b + p[1, 1] * b * b) / 2 + q[0] * a + q[1] * b
        k = value.argmin()
        v = np.linalg.lstsq(np.stack([m, g], 1), out - g, rcond=None)[0]
        got = (v @ p @ v) / 2 + q @ v
        assert got <= value.ravel()[k] + 1e-6 and (v >= 0.5 - 1e-9).all()


def test_attention_gradient_against_differences():
    rel = np.random.default_rng(2).normal(size=(3, 8))
    exact = L.attention_gradient(rel, 4, 2)
    for i in range(3):
        for j in range(8):
            up, down = rel.copy(), rel.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert abs((L.attention_rest(up, 4, 2) - L.attention_rest(down, 4, 2)) / 2e-6 - exact[i, j]) < 1e-6


def test_one_partition_steps_like_a_plain_loop(spark):
    rows = [(k % 9, k % 2, (k * 5 + 1) % 9) for k in range(30)]
    facts = spark.createDataFrame(rows, "h bigint, r bigint, t bigint").coalesce(1)
    s = L.Settings(dim=4, margin=1.0, rate=0.1, batch=10, negatives=2, optimiser="adagrad")
    model = L.Model(L._rows(9, 4, 1), L._rows(2, 4, 2))
    ent, rel = model.ent.copy(), model.rel.copy()
    model.tracked = [[np.zeros_like(m), np.zeros_like(m)] for m in (ent, rel)]
    L._epoch(facts, model, s, 0, L.Extra(track=True))
    steps = [L.Optimiser("adagrad", 0.1, [np.zeros_like(m)]) for m in (ent, rel)]
    fisher = [np.zeros_like(ent), np.zeros_like(rel)]
    data = np.array(rows)
    for low in range(0, 30, 10):
        h, r, t = data[low : low + 10].T
        batch = L._corrupted(h, r, t, 9, s, [s.seed, 0, int(h[0]), int(t[0]), 10])
        grads = L.gradients(ent, rel, *batch, s.margin, None)[:2]
        for k, (g, v) in enumerate(zip(grads, (ent, rel))):
            steps[k].step(v, g)
            fisher[k] += 10 * g * g
    ent /= np.maximum(np.linalg.norm(ent, axis=1, keepdims=True), 1.0)
    assert np.allclose(model.ent, ent) and np.allclose(model.rel, rel)
    assert np.allclose(model.tracked[0][0], fisher[0]) and np.allclose(model.tracked[1][0], fisher[1])


def test_reconstruction_on_tables_and_on_matrices(spark):
    rows = [(k % 7, k % 2, (k * 3 + 1) % 7) for k in range(20)]
    facts = spark.createDataFrame(rows, "h bigint, r bigint, t bigint")
    model = L.Model(L._rows(7, 4, 1), L._rows(2, 4, 2))
    tables = L.model_tables(spark, model)
    parts = [tables.filter(F.col("kind") == kind).select("id", "vec") for kind in ("entity", "relation")]
    ent, rel = ({r.id: r.vec for r in x.collect()} for x in L.reconstructed(facts, *parts))
    e, r = L.rebuilt(facts, model)
    assert np.allclose(e, [ent[k] for k in range(7)]) and np.allclose(r, [rel[k] for k in range(2)])


def test_continual_report(spark):
    one = spark.createDataFrame([(k % 10, k % 2, (k * 3) % 10) for k in range(30)], "h bigint, r bigint, t bigint")
    two = spark.createDataFrame([(k % 14, k % 3, (k * 5) % 14) for k in range(30)], "h bigint, r bigint, t bigint")
    report = L.continual_report([one, two], [(10, 2), (14, 3)], "finetune", L.Settings(dim=8, margin=1.0, epochs=1, batch=32, negatives=2))
    assert len(report["before"]) == len(report["first"]) == len(report["final"]) == 2
    assert abs(report["bwt"] - (report["final"][0] - report["first"][0])) < 1e-9 and 0 < report["whole"] <= 1

"""Clusters of graph vectors: assignment, k-means, density, quality, streams, majority evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.operators.vectors import element_stats, gathered
from tracewright.session import stored

#: Bytes of centres that assignment may hold in each worker.
MAX_CENTRE_BYTES = 256 << 20


def held_centres(centres: DataFrame, *columns: str) -> list:
    """The rows of a table of centres, after a check that their vectors fit into a worker."""
    sized = centres.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).first()
    if sized["n"] * max(sized["d"], 1) * 8 > MAX_CENTRE_BYTES:
        raise ValueError(f"{sized['n']} centres of {sized['d']} elements are more than {MAX_CENTRE_BYTES} bytes")
    return centres.select(*columns).collect()


def centroids(vectors: DataFrame, label: str, how: str = "mean") -> DataFrame:
    """(label, vec): mean (or sum) of the vectors of each label."""
    return gathered(element_stats(vectors, [label]), [label], how)


def assign(vectors: DataFrame, centres: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, distance): each vector's nearest centre by squared Euclid, ties to the smaller label.

    Centres are few by nature; their number is checked before they go to the workers.
    """
    listed = held_centres(centres, label, "vec")
    listed.sort(key=lambda r: r[0])
    names = pa.array([r[0] for r in listed], to_arrow_type(centres.schema[label].dataType))
    matrix = np.array([r[1] for r in listed], float)
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, {label} {centres.schema[label].dataType.simpleString()}, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            if not len(x):
                continue
            d = np.stack([((x - c) ** 2).sum(1) for c in matrix], 1)
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(best)), pa.array(d[np.arange(len(x)), best])], names=[key, label, "distance"])

    if not listed:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select(key, "vec").mapInArrow(run, schema)


def centre_members(assigned: DataFrame, key: str, label: str) -> DataFrame:
    """The member nearest to each centre, ties to the smaller key."""
    best = F.min(F.struct("distance", key)).alias("b")
    return assigned.groupBy(label).agg(best).select(label, F.col(f"b.{key}").alias(key), F.col("b.distance").alias("distance"))


def kmeans(vectors: DataFrame, seeds: DataFrame, key: str, label: str, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(key, label, distance) after Lloyd rounds from given centres (label, vec); empty clusters keep their centre."""
    vectors = vectors.select(key, "vec")
    centres, last = seeds, None
    for _ in range(rounds):
        assigned = stored(assign(vectors, centres, key, label))
        cost = assigned.agg(F.sum("distance")).first()[0]
        if cost is None or (last is not None and last - cost <= tolerance * max(last, 1e-12)):
            return assigned
        last = cost
        means = centroids(vectors.join(assigned.select(key, label), key), label)
        kept = centres.join(means.select(label), label, "left_anti").select(label, "vec")
        centres = stored(means.unionByName(kept))
    return assign(vectors, centres, key, label)


def minibatch_step(batch: DataFrame, centres: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """((key, label, distance), centres) of one batch: its vectors by the centres as they were, and the centres moved to the running mean.

    ``centres`` have (label, vec, n), n the vectors that each stands for so far (0 for a seed).
    """
    assigned = stored(assign(batch, centres, key, label))
    stats = centroids(batch.join(assigned.select(key, label), key), label, "sum").withColumnRenamed("vec", "total")
    counts = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("m"))
    joined = centres.join(stats, label, "left").join(counts, label, "left").na.fill(0, ["m"])
    n = F.col("n") + F.col("m")
    moved = F.when(F.col("m") == 0, F.col("vec")).otherwise(F.zip_with("vec", "total", lambda c, t: (c * F.col("n") + t) / n))
    return assigned, joined.select(label, moved.alias("vec"), n.alias("n"))


def hashed_seeds(vectors: DataFrame, key: str, k: int, label: str = "label") -> DataFrame:
    """(label, vec, n): k vectors as seeds, those whose keys hash lowest."""
    first = vectors.orderBy(F.xxhash64(key), key).limit(k)
    order = Window.orderBy(F.xxhash64(key), key)  # k rows
    return first.select((F.row_number().over(order) - 1).alias(label), "vec", F.lit(0).cast("bigint").alias("n"))


def neighbour_pairs(vectors: DataFrame, key: str, eps: float, dims: int = 3) -> DataFrame:
    """(a, b): vectors within ``eps``, by a grid of cells of that width over the elements of most spread.

    Each vector looks at the neighbouring cells of its own only, and the distance is checked in full.
    """
    spread = element_stats(vectors, []).orderBy(F.desc("std"), "i").limit(dims).collect()
    axes = [r["i"] for r in spread]
    cell = F.array(*[F.floor(F.get("vec", F.lit(i)) / eps).cast("bigint") for i in axes])
    own = vectors.select(F.col(key).alias("b"), F.col("vec").alias("bv"), cell.alias("cell"))
    offsets = [[]]
    for _ in axes:
        offsets = [[*o, s] for o in offsets for s in (-1, 0, 1)]
    around = F.explode(F.array(*[F.array(*[F.get(cell, F.lit(k)) + s for k, s in enumerate(o)]) for o in offsets]))
    asked = vectors.select(F.col(key).alias("a"), F.col("vec").alias("av"), around.alias("cell"))
    square = F.aggregate(F.zip_with("av", "bv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return asked.join(own, "cell").filter(square <= eps * eps).select("a", "b")


def dbscan(vectors: DataFrame, key: str, eps: float, min_points: int) -> DataFrame:
    """(key, cluster, core): core points have enough neighbours (themselves too); borders join their smallest cluster; noise is null."""
    from tracewright.operators.graph import components

    pairs = stored(neighbour_pairs(vectors, key, eps))
    core = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points).select(F.col("a").alias("p")))
    links = pairs.join(core, pairs.a == core.p, "left_semi").join(core, pairs.b == core.p, "left_semi")
    labelled = components(links.select(F.lit(0).alias("g"), F.col("a").alias("src"), F.col("b").alias("dst")), ["g"]).select(F.col("node").alias("p"), F.col("component").alias("cluster"))
    near = pairs.join(labelled, pairs.b == labelled.p).groupBy("a").agg(F.min("cluster").alias("near"))
    everyone = vectors.select(F.col(key).alias("a")).join(labelled.withColumnRenamed("p", "a"), "a", "left").join(near, "a", "left")
    return everyone.select(F.col("a").alias(key), F.coalesce("cluster", "near").alias("cluster"), F.col("cluster").isNotNull().alias("core"))


def quality(vectors: DataFrame, key: str, label: str) -> DataFrame:
    """Simplified silhouette over squared distances to centres, and the Davies-Bouldin index.

    Squared distances of a vector to all of a cluster are had from the cluster's sums, so the exact
    silhouette with squared Euclid needs no pairs of vectors.
    """
    n = F.count(F.lit(1))
    norms = vectors.withColumn("q", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    stats = gathered(element_stats(vectors, [label]), [label], "sum").withColumnRenamed("vec", "total")
    sums = norms.groupBy(label).agg(n.alias("n"), F.sum("q").alias("qq")).join(stats, label)
    listed = held_centres(sums.withColumn("vec", F.col("total")), label, "n", "qq", "total")
    listed.sort(key=lambda r: r[0])
    sizes = np.array([r["n"] for r in listed], float)
    squares, totals = np.array([r["qq"] for r in listed], float), np.array([r["total"] for r in listed], float)
    where = {r[0]: k for k, r in enumerate(listed)}

    def silhouettes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            if not len(x):
                continue
            own = np.array([where[v] for v in batch.column(0).to_pylist()])
            to = sizes * (x * x).sum(1)[:, None] - 2 * x @ totals.T + squares
            rows = np.arange(len(x))
            a = np.maximum(to[rows, own], 0) / np.maximum(sizes[own] - 1, 1)
            mean = to / sizes
            mean[rows, own] = np.inf
            b = mean.min(1)
            s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(np.isfinite(s), s, 0.0))], names=["s"])

    silhouette = vectors.select(label, "vec").mapInArrow(silhouettes, "s double").agg(F.avg("s").alias("silhouette"))
    centres = vectors.sparkSession.createDataFrame([(r[0], [t / r["n"] for t in r["total"]]) for r in listed], f"{label} {vectors.schema[label].dataType.simpleString()}, c array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with("vec", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    scatter = vectors.join(F.broadcast(centres), label).groupBy(label).agg(F.avg(gap).alias("s")).collect()
    wide = {r[0]: r["s"] for r in scatter}
    middle = totals / sizes[:, None]
    worst = []
    for i, r in enumerate(listed):
        d = np.sqrt(((middle - middle[i]) ** 2).sum(1))
        worst.append(max(((wide[r[0]] + wide[o[0]]) / d[j] for j, o in enumerate(listed) if j != i and d[j] > 0), default=0.0))
    return silhouette.withColumn("davies_bouldin", F.lit(float(np.mean(worst)) if worst else None).cast("double"))


def density(assigned: DataFrame, label: str) -> DataFrame:
    """Per cluster mean root distance / ln(n + 10), clipped to the 30th and 70th percentile, over its mean plus 0.5."""
    raw = assigned.groupBy(label).agg((F.avg(F.sqrt(F.greatest("distance", F.lit(0.0)))) / F.log(F.count(F.lit(1)) + 10)).alias("d"))
    bounds = raw.agg(F.percentile("d", F.lit(0.3)).alias("lo"), F.percentile("d", F.lit(0.7)).alias("hi")).first()
    clipped = raw.withColumn("d", F.greatest(F.least("d", F.lit(bounds["hi"])), F.lit(bounds["lo"])))
    mean = clipped.agg(F.avg("d")).first()[0]
    return clipped.select(label, (F.col("d") / F.lit(mean) + 0.5).alias("density"))


def majority_labels(members: DataFrame, cluster: str, label: str) -> DataFrame:
    """The most frequent label of each cluster, ties to the smaller label."""
    counted = members.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("b")).select(cluster, F.col("b.l").alias("predicted"))


def weighted_scores(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; an undefined precision is 0."""
    n = F.count(F.lit(1))
    cells = pairs.groupBy(actual, predicted).agg(n.alias("n"))
    right = cells.filter(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("c"), F.col("n").alias("tp"))
    support = cells.groupBy(F.col(actual).alias("c")).agg(F.sum("n").alias("support"))
    called = cells.groupBy(F.col(predicted).alias("c")).agg(F.sum("n").alias("called"))
    per = support.join(right, "c", "left").join(called, "c", "left").na.fill(0, ["tp", "called"])
    p = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    whole = F.sum("support")
    return per.withColumns({"p": p, "r": r, "f": f}).agg(
        (F.sum("tp") / whole).alias("accuracy"), (F.sum(F.col("p") * F.col("support")) / whole).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / whole).alias("recall"), (F.sum(F.col("f") * F.col("support")) / whole).alias("f1"),
    )


class MicroClusters:
    """DenStream: decaying potential and outlier micro-clusters of a stream.

    A cluster fades by 2^-decay with every sample it takes; an outlier is held to the weight that its age
    since it was made asks for.
    """

    def __init__(self, eps: float, beta: float, mu: float, decay: float) -> None:
        self.eps, self.least, self.decay = eps, beta * mu, decay
        self.kept: list[list] = []  # potential: [mean, variance sum, weight, time made]
        self.loose: list[list] = []  # outlier
        self.now = 0
        ratio = self.least / max(self.least - 1, 1e-9)
        self.every = max(1, int(np.ceil(np.log(max(ratio, 1.0 + 1e-9)) / decay))) if decay > 0 else 1 << 30

    def _with(self, c: list, x: np.ndarray, w: float) -> list:
        weight = c[2] * 2.0**-self.decay + w
        mean = c[0] + (w / weight) * (x - c[0])
        spread = c[1] * ((weight - w) / c[2]) + w * (x - mean) * (x - c[0])
        return [mean, spread, weight, c[3]]

    @staticmethod
    def radius(c: list) -> float:
        return float(np.linalg.norm(np.sqrt(np.maximum(c[1], 0) / c[2])))

    @staticmethod
    def nearest(group: list[list], x: np.ndarray) -> int:
        return int(np.argmin([np.linalg.norm(c[0] - x) for c in group]))

    def _try(self, group: list[list], x: np.ndarray, w: float) -> int | None:
        if not group:
            return None
        k = self.nearest(group, x)
        trial = self._with(group[k], x, w)
        if self.radius(trial) > self.eps:
            return None
        group[k] = trial
        return k

    def add(self, x: np.ndarray, w: float = 1.0) -> None:
        if self._try(self.kept, x, w) is None:
            k = self._try(self.loose, x, w)
            if k is None:
                self.loose.append([x.astype(float), np.zeros(len(x)), w, self.now])
            elif self.loose[k][2] > self.least:
                self.kept.append(self.loose.pop(k))
        if self.now % self.every == 0:
            self.kept = [c for c in self.kept if c[2] >= self.least]
            self.loose = [c for c in self.loose if c[2] >= self._asked(c)]
        self.now += 1

    def _asked(self, c: list) -> float:
        fade = lambda t: 2.0 ** (-self.decay * t) - 1
        return fade(self.now - c[3] + self.every) / fade(self.every) if self.decay > 0 else 0.0

    def labels(self, eps: float = 0.3, min_weight: float = 5.0) -> list[int]:
        """DBSCAN of the potential clusters by their weights: a number for each, -1 for noise."""
        if not self.kept:
            return []
        centres, weights = np.array([c[0] for c in self.kept]), np.array([c[2] for c in self.kept])
        near = [np.flatnonzero(np.linalg.norm(centres - x, axis=1) <= eps) for x in centres]
        core = [weights[n].sum() >= min_weight for n in near]
        out, next_ = [-1] * len(centres), 0
        for k in range(len(centres)):
            if not core[k] or out[k] >= 0:
                continue
            todo, out[k] = [k], next_
            while todo:
                for n in near[todo.pop()]:
                    if out[n] < 0:
                        out[n] = next_
                        if core[n]:
                            todo.append(n)
            next_ += 1
        return out


def denstream_labels(vectors: DataFrame, keys: list[str], key: str, folded: DataFrame) -> DataFrame:
    """(keys, key, cluster): every vector by the label of its nearest potential cluster of ``folded``; null in streams without one.

    Streams have few potential clusters; they are gathered to one row a stream and joined.
    """
    held = folded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "centre", "cluster"))).alias("__c"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    far = F.transform("__c", lambda c: F.struct(square(F.col("vec"), c["centre"]).alias("d"), c["number"].alias("number"), c["cluster"].alias("cluster")))
    return vectors.join(held, keys, "left").select(*keys, key, F.array_min(far)["cluster"].alias("cluster"))


def denstream(vectors: DataFrame, keys: list[str], order: list[str], eps: float, beta: float, mu: float, decay: float) -> DataFrame:
    """(keys, number, centre, weight, cluster): potential micro-clusters per stream, folded in order with bounded state.

    ``cluster`` is the final grouping of the micro-clusters, -1 for those that are noise.

    A stream is one ordered fold by nature; rows reach it sorted in batches, and only its
    micro-clusters are held.
    """
    ordered = vectors.select(*keys, *order, "vec").repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys) + ", number int, centre array<double>, weight double, cluster int"

    def out(key: tuple, state: MicroClusters) -> pd.DataFrame:
        rows = [(*key, k, c[0].tolist(), c[2], label) for k, (c, label) in enumerate(zip(state.kept, state.labels(), strict=True))]
        return pd.DataFrame(rows, columns=[*keys, "number", "centre", "weight", "cluster"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            columns = [batch[c].tolist() for c in keys]
            for k, vec in zip(zip(*columns, strict=True), batch["vec"], strict=True):
                if k != current:
                    if state is not None:
                        yield out(current, state)
                    current, state = k, MicroClusters(eps, beta, mu, decay)
                state.add(np.asarray(vec, float))
        if state is not None:
            yield out(current, state)

    return ordered.mapInPandas(fold, schema)


class FeatureVectors:
    """CluStream: at most ``m`` micro-clusters of a stream as counts, sums, squares and times."""

    def __init__(self, m: int, horizon: int, factor: float = 2.0) -> None:
        self.m, self.horizon, self.factor = m, horizon, factor
        self.now = 0
        self.held: list[list] = []  # [n, sum, squares, sum of times]

    def add(self, x: np.ndarray) -> None:
        self.now += 1
        if self.held:
            centres = np.stack([c[1] / c[0] for c in self.held])
            gaps = np.sqrt(((centres - x) ** 2).sum(1))
            k = int(gaps.argmin())
            n, total, squares, _ = self.held[k]
            if n > 1:
                reach = self.factor * float(np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0).sum()))
            else:  # a single vector reaches half way to its neighbour
                others = np.sqrt(((np.delete(centres, k, 0) - centres[k]) ** 2).sum(1))
                reach = float(others.min()) / 2 if len(others) else 0.0
            if gaps[k] <= reach:
                c = self.held[k]
                self.held[k] = [c[0] + 1, c[1] + x, c[2] + x * x, c[3] + self.now]
                return
        self.held.append([1, x.astype(float), (x * x).astype(float), self.now])
        if len(self.held) > self.m:
            self._make_room()

    def _make_room(self) -> None:
        """Drop the cluster whose mean time is oldest and past the horizon, else join the two nearest."""
        ages = [self.now - c[3] / c[0] for c in self.held]
        k = int(np.argmax(ages))
        if ages[k] > self.horizon:
            self.held.pop(k)
            return
        centres = np.stack([c[1] / c[0] for c in self.held])
        d = ((centres[:, None] - centres[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        i, j = sorted(divmod(int(d.argmin()), len(centres)))
        b = self.held.pop(j)
        self.held[i] = [x + y for x, y in zip(self.held[i], b, strict=True)]


def clustream(vectors: DataFrame, keys: list[str], order: list[str], m: int = 256, horizon: int = 400) -> DataFrame:
    """(keys, micro, vec, weight): micro-cluster centres of each stream, to be clustered further by k-means."""
    ordered = vectors.select(*keys, *order, "vec").repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys) + ", micro int, vec array<double>, weight double"

    def out(key: tuple, state: FeatureVectors) -> pd.DataFrame:
        rows = [(*key, k, (c[1] / c[0]).tolist(), float(c[0])) for k, c in enumerate(state.held)]
        return pd.DataFrame(rows, columns=[*keys, "micro", "vec", "weight"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            columns = [batch[c].tolist() for c in keys]
            for k, vec in zip(zip(*columns, strict=True), batch["vec"], strict=True):
                if k != current:
                    if state is not None:
                        yield out(current, state)
                    current, state = k, FeatureVectors(m, horizon)
                state.add(np.asarray(vec, float))
        if state is not None:
            yield out(current, state)

    return ordered.mapInPandas(fold, schema)


def prototype_merges(prototypes: DataFrame, key: str, share: float) -> DataFrame:
    """(a, b) prototypes nearer than the k-th smallest nearest distance; prototypes are a bounded set."""
    listed = held_centres(prototypes, key, "vec")
    listed.sort(key=lambda r: r[0])
    x = np.array([r[1] for r in listed], float)
    schema = f"a {prototypes.schema[key].dataType.simpleString()}, b {prototypes.schema[key].dataType.simpleString()}"
    if len(x) < 2:
        return prototypes.sparkSession.createDataFrame([], schema)

    def row(i: int) -> np.ndarray:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        return d

    # Distances are made a row at a time, so that only one row is held.
    nearest = np.sort([row(i).min() for i in range(len(x))])
    limit = nearest[min(len(nearest) - 1, max(0, int(share * len(nearest)) - 1))]
    pairs = [(listed[i][0], listed[j][0]) for i in range(len(x)) for j in np.flatnonzero(row(i) <= limit + 1e-9) if j > i]
    return prototypes.sparkSession.createDataFrame(pairs, schema)


def prototype_scores(vectors: DataFrame, prototypes: DataFrame, key: str, temperature: float = 0.2) -> DataFrame:
    """(key, score): least exp(cos / (temperature * density)) over prototypes (vec, density), a bounded set."""
    listed = held_centres(prototypes, "vec", "density")
    c = np.array([r["vec"] for r in listed], float)
    width = np.array([r["density"] for r in listed], float) * temperature
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.stack(v.map(np.asarray).to_list()).astype(float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.Series(np.exp((x @ c.T) / width).min(1))

    return vectors.select(key, score("vec").alias("score"))


def z_sum(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Rows with the sum of their z-scored columns; a column without spread counts 0."""
    stats = rows.agg(*[e for c in scores for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    parts = [((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])) if stats[f"s_{c}"] else F.lit(0.0) for c in scores]
    return rows.withColumn("z", sum(parts[1:], parts[0]))


def adaptive_weights(losses: DataFrame, columns: list[str], alpha: float) -> DataFrame:
    """Weights std^alpha of each loss, normalised to sum to 1."""
    stats = losses.agg(*[F.pow(F.stddev_pop(c), alpha).alias(c) for c in columns])
    whole = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return stats.select(*[(F.col(c) / whole).alias(c) for c in columns])


def biased_split(rows: DataFrame, group: str, label: str, key: str, shares: dict, rest: float) -> DataFrame:
    """``split`` train or test: of each (group, label), the share given for it (else ``rest``) in key order is train."""
    by = Window.partitionBy(group, label)
    counted = rows.withColumns({"__k": F.row_number().over(by.orderBy(key)), "__n": F.count(F.lit(1)).over(by)})
    share = F.lit(rest)
    for (g, v), s in shares.items():
        share = F.when((F.col(group) == g) & (F.col(label) == v), s).otherwise(share)
    return counted.withColumn("split", F.when(F.col("__k") <= F.floor(F.col("__n") * share), "train").otherwise("test")).drop("__k", "__n")

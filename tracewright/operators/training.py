"""Translational embeddings of triples, static and over snapshots that arrive one after the other.

Facts stay distributed. The embedding matrices are the model: their size is checked, they go to the
workers each epoch, every partition takes its own steps, and the rows it touched come back summed by
id, so the driver receives one row an entity and relation, never facts.

Snapshot strategies differ in what the next snapshot starts from, what it may change and what pulls
it back; all are additions to one step. Two are simpler than the models whose names they carry: ``lan``
weighs neighbours by their likeness only, without the overlap of relations (``relation_overlap``), and
in ``lkge`` and ``dlkge`` the rebuilt rows that pull an epoch's steps are held fixed in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.vectors import minus, plus, readout
from tracewright.session import stored

#: Numbers that the matrices may hold together.
MAX_NUMBERS = 500_000_000
STRATEGIES = ["finetune", "snapshot_only", "retraining", "pnn", "cwr", "ewc", "si", "emr", "gem", "mean", "lan", "lkge", "dlkge"]


@dataclass
class Model:
    """Entity and relation matrices and what strategies remember of earlier snapshots."""

    ent: np.ndarray
    rel: np.ndarray
    seen_ent: np.ndarray | None = None
    seen_rel: np.ndarray | None = None
    weight_ent: np.ndarray | None = None
    weight_rel: np.ndarray | None = None
    merged: tuple[np.ndarray, np.ndarray] | None = None
    memory: DataFrame | None = None
    log: list[dict] = field(default_factory=list)
    steps: int = 0
    held: list[list[np.ndarray]] | None = None
    #: Squared gradients and paths of entities and of relations, where a strategy tracks them.
    tracked: list[list[np.ndarray]] = field(default_factory=lambda: [[], []])

    def states(self, optimiser: str) -> list[list[np.ndarray]]:
        """What the optimiser remembers of both matrices; begun anew when their shape has changed."""
        n = Optimiser.STATES[optimiser]
        if self.held is None or any(len(h) != n or any(x.shape != m.shape for x in h) for h, m in zip(self.held, (self.ent, self.rel), strict=True)):
            self.held, self.steps = [[np.zeros_like(m) for _ in range(n)] for m in (self.ent, self.rel)], 0
        return self.held


@dataclass
class Settings:
    dim: int = 64
    margin: float = 8.0
    rate: float = 0.01
    negatives: int = 5
    epochs: int = 10
    batch: int = 1024
    optimiser: str = "sgd"
    pull: float = 0.1
    rebuild: float = 0.1
    memory: int = 1000
    factors: int = 4
    top: int = 2
    patience: int = 4
    seed: int = 11


def _rows(n: int, dim: int, seed: int) -> np.ndarray:
    """Xavier-like rows that depend on seed and position only."""
    out = np.random.default_rng(seed).uniform(-1, 1, (n, dim)) * np.sqrt(6 / dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def factor_mask(rel: np.ndarray, factors: int, top: int) -> np.ndarray:
    """1 on the blocks that each relation attends to most (softmax over block norms), else 0."""
    blocks = np.linalg.norm(rel.reshape(len(rel), factors, -1), axis=2)
    order = np.argsort(-blocks, axis=1, kind="stable")[:, :top]
    mask = np.zeros_like(blocks)
    np.put_along_axis(mask, order, 1.0, 1)
    return np.repeat(mask, rel.shape[1] // factors, axis=1)


def attention_rest(rel: np.ndarray, factors: int, top: int) -> float:
    """Mean attention mass outside the attended blocks; a loss of the disentangled model."""
    blocks = np.linalg.norm(rel.reshape(len(rel), factors, -1), axis=2)
    share = np.exp(blocks - blocks.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    return float(np.mean(1 - np.sort(share, axis=1)[:, -top:].sum(1)))


def gradients(ent: np.ndarray, rel: np.ndarray, h: np.ndarray, r: np.ndarray, t: np.ndarray, nh: np.ndarray, nt: np.ndarray, margin: float, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sub-gradients of max(0, margin + |h + r - t| - |h' + r - t'|), and the mean loss."""
    good, bad = ent[h] + rel[r] - ent[t], ent[nh] + rel[r] - ent[nt]
    if mask is not None:
        good, bad = good * mask[r], bad * mask[r]
    loss = margin + np.abs(good).sum(1) - np.abs(bad).sum(1)
    on = (loss > 0)[:, None]
    g, b = np.sign(good) * on, np.sign(bad) * on
    ge, gr = np.zeros_like(ent), np.zeros_like(rel)
    for where, what in ((h, g), (t, -g), (nh, -b), (nt, b)):
        np.add.at(ge, where, what)
    np.add.at(gr, r, g - b)
    return ge / max(len(h), 1), gr / max(len(h), 1), float(np.maximum(loss, 0).mean()) if len(h) else 0.0


class Optimiser:
    """Steps of one matrix: sgd, adagrad, adadelta or adam; what it remembers lies in ``state``, arrays of the matrix's shape."""

    STATES = {"sgd": 0, "adagrad": 1, "adadelta": 2, "adam": 2}

    def __init__(self, name: str, rate: float, state: list[np.ndarray], steps: int = 0) -> None:
        self.name, self.rate, self.state, self.steps = name, rate, state, steps

    def step(self, values: np.ndarray, gradient: np.ndarray) -> None:
        """Change ``values`` in place."""
        self.steps += 1
        if self.name == "sgd":
            values -= self.rate * gradient
        elif self.name == "adagrad":
            self.state[0] += gradient * gradient
            values -= self.rate * gradient / (np.sqrt(self.state[0]) + 1e-10)
        elif self.name == "adadelta":
            seen, made = self.state
            seen *= 0.9
            seen += 0.1 * gradient * gradient
            move = np.sqrt(made + 1e-6) / np.sqrt(seen + 1e-6) * gradient
            made *= 0.9
            made += 0.1 * move * move
            values -= self.rate * move
        else:
            first, second = self.state
            first *= 0.9
            first += 0.1 * gradient
            second *= 0.999
            second += 0.001 * gradient * gradient
            fair = first / (1 - 0.9**self.steps), second / (1 - 0.999**self.steps)
            values -= self.rate * fair[0] / (np.sqrt(fair[1]) + 1e-8)


def projected(gradient: np.ndarray, memory: np.ndarray, margin: float = 0.5, eps: float = 1e-3) -> np.ndarray:
    """The gradient turned so that it conflicts with that of the memory no longer; as it is where it does not conflict.

    The least v >= margin of v'Pv / 2 + (Mg)'v, M the two gradients and P their products, solved by trying which
    of the two bounds hold; the result is g + M'v.
    """
    if float(gradient @ memory) >= 0:
        return gradient
    m = np.stack([memory, gradient])
    p, q = m @ m.T + np.eye(2) * eps, m @ gradient
    best, least = None, np.inf
    for held in ((), (0,), (1,), (0, 1)):
        v = np.full(2, margin)
        free = [k for k in (0, 1) if k not in held]
        if free:
            right = -q[free] - p[np.ix_(free, list(held))] @ v[list(held)]
            v[free] = np.linalg.solve(p[np.ix_(free, free)], right)
        if (v >= margin - 1e-12).all() and (value := v @ p @ v / 2 + q @ v) < least:
            best, least = v, value
    return gradient + best @ m


def attention_gradient(rel: np.ndarray, factors: int, top: int) -> np.ndarray:
    """Gradient of ``attention_rest`` by the relation matrix."""
    blocks = rel.reshape(len(rel), factors, -1)
    norms = np.linalg.norm(blocks, axis=2)
    share = np.exp(norms - norms.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    taken = np.zeros_like(share)
    np.put_along_axis(taken, np.argsort(-share, axis=1, kind="stable")[:, :top], 1.0, 1)
    by_norm = -share * (taken - (share * taken).sum(1, keepdims=True))
    return (by_norm[..., None] * blocks / np.maximum(norms[..., None], 1e-12)).reshape(rel.shape) / max(len(rel), 1)


@dataclass
class Extra:
    """What a strategy adds to the plain steps of a snapshot."""

    pull: tuple | None = None  # (weights, old rows) of entities and of relations
    frozen: tuple | None = None  # so many first entities and relations stay
    mask: bool = False  # only the attended blocks count, and attention outside of them is a loss
    memory: tuple | None = None  # (h, r, t) of remembered facts that gradients must not conflict with
    target: tuple | None = None  # reconstructed entities and relations, held during an epoch
    track: bool = False  # squared gradients and the path of the parameters are summed up


def _corrupted(h: np.ndarray, r: np.ndarray, t: np.ndarray, n_ent: int, s: Settings, seed: list[int]) -> tuple:
    """Facts repeated for each negative, with heads or tails replaced."""
    draw = np.random.default_rng(seed)
    h, r, t = (np.repeat(x, s.negatives) for x in (h, r, t))
    other, side = draw.integers(0, n_ent, len(h)), draw.random(len(h)) < 0.5
    return h, r, t, np.where(side, other, h), np.where(side, t, other)


def _summed(rows: DataFrame) -> DataFrame:
    """(kind, id, n, d): counts and vectors of equal kind and id added up, within partitions after one exchange by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ident = (batch.column(k).to_numpy() for k in (0, 1))
            for one in np.unique(kind):
                at = np.flatnonzero(kind == one)
                ids, place = np.unique(ident[at], return_inverse=True)
                vectors = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                n, d = np.zeros(len(ids)), np.zeros((len(ids), vectors.shape[1]))
                np.add.at(n, place, batch.column(2).to_numpy()[at])
                np.add.at(d, place, vectors)
                yield _sums(int(one), ids, n, d)

    return rows.repartition("kind", "id").mapInArrow(run, _SUMS)


_SUMS = "kind int, id bigint, n double, d array<double>"


def _sums(kind: int, ids: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
    columns = [pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int64)), pa.array(n.astype(float)), lists]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "n", "d"])


def _epoch(facts: DataFrame, model: Model, s: Settings, epoch: int, extra: Extra) -> float:
    """One pass over the facts: partitions step on their own copies, and the changes are averaged by id."""
    spark = facts.sparkSession
    states = model.states(s.optimiser)
    held = spark.sparkContext.broadcast((model.ent, model.rel, states, model.steps, extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ent0, rel0, states0, steps, more = held.value
        values = [ent0.copy(), rel0.copy()]
        optimisers = [Optimiser(s.optimiser, s.rate, [x.copy() for x in states0[k]], steps) for k in (0, 1)]
        tracked = [[np.zeros_like(v), np.zeros_like(v)] for v in values] if more.track else [[], []]
        total, n = 0.0, 0
        for batch in batches:
            h, r, t = (np.asarray(batch.column(k)) for k in range(3))
            for low in range(0, len(h), s.batch):
                a, q, b = (x[low : low + s.batch] for x in (h, r, t))
                ent, rel = values
                mask = factor_mask(rel, s.factors, s.top) if more.mask else None
                # Corruption is drawn from the facts themselves, so it does not depend on the partition.
                a, q, b, na, nb = _corrupted(a, q, b, len(ent), s, [s.seed, epoch, int(a[0]), int(b[0]), len(a)])
                grads = list(gradients(ent, rel, a, q, b, na, nb, s.margin, mask))
                loss = grads.pop()
                if more.memory is not None:
                    old = _corrupted(*more.memory, len(ent), s, [s.seed, epoch, n])
                    kept = gradients(ent, rel, *old, s.margin, mask)[:2]
                    flat = projected(np.concatenate([g.ravel() for g in grads]), np.concatenate([g.ravel() for g in kept]))
                    grads = [flat[: ent.size].reshape(ent.shape), flat[ent.size :].reshape(rel.shape)]
                for k, (g, v) in enumerate(zip(grads, values, strict=True)):
                    if more.pull is not None:
                        weight, before = more.pull[k]
                        g[: len(before)] += 2 * s.pull * weight * (v[: len(before)] - before)
                    if more.target is not None:
                        g += 2 * s.rebuild * (v - more.target[k]) / len(v)
                    if more.mask and k == 1:
                        g += attention_gradient(v, s.factors, s.top)
                    if more.frozen is not None:
                        g[: more.frozen[k]] = 0
                    past = v.copy() if more.track else None
                    optimisers[k].step(v, g)
                    if more.track:
                        tracked[k][0] += len(a) // s.negatives * g * g
                        tracked[k][1] -= g * (v - past)
                total, n = total + loss * len(a), n + len(a)
        yield _sums(2, np.array([0]), np.array([n]), np.array([[total, optimisers[0].steps]]))
        for k in (0, 1):
            new, old = [values[k], *optimisers[k].state], [(ent0, rel0)[k], *states0[k]]
            moved = np.flatnonzero(np.abs(new[0] - old[0]).sum(1)) if n else np.zeros(0, int)
            if len(moved):
                parts = [(x - y)[moved] * n for x, y in zip(new, old, strict=True)] + [x[moved] for x in tracked[k]]
                yield _sums(k, moved, np.full(len(moved), n), np.concatenate(parts, 1))

    loss = seen = 0.0
    steps = model.steps
    changes: dict[tuple[int, int], list] = {}
    for row in _summed(facts.select("h", "r", "t").mapInArrow(run, _SUMS)).toLocalIterator():
        d = np.array(row["d"])
        if row["kind"] == 2:
            loss, seen, steps = loss + d[0], seen + row["n"], max(steps, int(d[1]))
            continue
        # A row's changes may come in several parts, which are added up before they are averaged.
        had = changes.setdefault((row["kind"], row["id"]), [0.0, np.zeros(len(d))])
        had[0] += row["n"]
        had[1] += d
    for (kind, at), (n, d) in changes.items():
        parts = np.split(d, len(d) // s.dim)
        for x in [(model.ent, model.rel)[kind], *states[kind]]:
            x[at] += parts.pop(0) / n
        for x, part in zip(model.tracked[kind], parts, strict=False):
            x[at] += part
    model.steps = steps
    norm = np.linalg.norm(model.ent, axis=1, keepdims=True)
    model.ent /= np.maximum(norm, 1.0)
    return loss / seen if seen else 0.0


def fit(facts: DataFrame, model: Model, s: Settings, extra: Extra | None = None) -> list[float]:
    """Epochs until the loss has not fallen for ``patience`` of them; the losses. The model of the least loss is kept."""
    losses: list[float] = []
    best, since, kept = np.inf, 0, None
    for epoch in range(s.epochs):
        losses.append(_epoch(facts, model, s, epoch, extra or Extra()))
        if losses[-1] < best - 1e-9:
            best, since, kept = losses[-1], 0, (model.ent.copy(), model.rel.copy())
        else:
            since += 1
        if since >= s.patience:
            break
    if kept is not None:
        model.ent, model.rel = kept
    return losses


def train_static(facts: DataFrame, n_ent: int, n_rel: int, s: Settings | None = None) -> Model:
    """A model of one set of (h, r, t) facts with dense ids."""
    s = s or Settings()
    _checked(n_ent, n_rel, s)
    model = Model(_rows(n_ent, s.dim, s.seed), _rows(n_rel, s.dim, s.seed + 1))
    model.log.append({"losses": fit(stored(facts.select("h", "r", "t")), model, s)})
    return model


def _checked(n_ent: int, n_rel: int, s: Settings) -> None:
    if (n_ent + n_rel) * s.dim > MAX_NUMBERS:
        raise ValueError(f"the matrices would hold more than {MAX_NUMBERS} numbers")


def _counts(facts: DataFrame, n_ent: int, n_rel: int) -> tuple[np.ndarray, np.ndarray]:
    """Facts per entity and per relation."""
    e, r = np.zeros(n_ent), np.zeros(n_rel)
    ends = facts.select(F.lit(0).alias("k"), F.col("h").alias("id")).union(facts.select(F.lit(0), "t")).union(facts.select(F.lit(1), "r"))
    for row in ends.groupBy("k", "id").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        (e if row["k"] == 0 else r)[row["id"]] = row["n"]
    return e, r


def neighbour_mean(facts: DataFrame, model: Model, wanted: int, sample: int = 64, attention: bool = False, seed: int = 0) -> np.ndarray:
    """Vectors of the entities from ``wanted`` on as the mean (or attention-weighted mean) of h + r over sampled incoming facts.

    Entities are worked on where their sampled facts are, at most ``sample`` each; the driver gets one row an entity.
    """
    out = model.ent.copy()
    both = facts.select(F.col("t").alias("e"), F.col("h").alias("o"), "r", F.lit(1.0).alias("sign")).union(facts.select(F.col("h"), F.col("t"), "r", F.lit(-1.0)))
    order = Window.partitionBy("e").orderBy(F.xxhash64("o", "r", F.lit(seed)), "o", "r")
    taken = both.filter(F.col("e") >= wanted).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample)
    per = taken.groupBy("e").agg(F.collect_list(F.struct("o", "r", "sign")).alias("x"))
    held = facts.sparkSession.sparkContext.broadcast((model.ent, model.rel))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ent, rel = held.value
        for batch in batches:
            means = []
            for near in batch.column(1).to_pylist():
                old = [x for x in near if x["o"] < wanted] or near
                rows = np.stack([ent[x["o"]] + x["sign"] * rel[x["r"]] for x in old])
                if attention:
                    logit = rows @ rows.mean(0)
                    w = np.exp(logit - logit.max())
                    rows = rows * (w / w.sum())[:, None] * len(rows)
                means.append(rows.mean(0))
            if means:
                yield _sums(0, batch.column(0).to_numpy(), np.ones(len(means)), np.stack(means))

    for row in per.mapInArrow(run, _SUMS).toLocalIterator():
        out[row["id"]] = row["d"]
    return out


def reconstructed(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, vec) of entities, (id, vec) of relations) as their facts say: the autoencoder's layer.

    An entity is the mean of head plus relation over the facts it is the tail of and of itself, cut at 0; a
    relation the mean of tail minus head over its facts. ``entities`` and ``relations`` have (id, vec).
    """
    h, t = (entities.select(F.col("id").alias(c), F.col("vec").alias(f"{c}v")) for c in "ht")
    r = relations.select(F.col("id").alias("r"), F.col("vec").alias("rv"))
    joined = facts.select("h", "r", "t").join(h, "h").join(t, "t").join(r, "r")
    sent = joined.select(F.col("t").alias("id"), plus(F.col("hv"), F.col("rv")).alias("vec")).unionByName(entities.select("id", "vec"))
    means = readout(sent, ["id"], "mean").select("id", F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("vec"))
    return means, readout(joined.select(F.col("r").alias("id"), minus(F.col("tv"), F.col("hv")).alias("vec")), ["id"], "mean")


def rebuilt(facts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The layer of ``reconstructed`` on a model's matrices: partitions add up by id, the driver gets one row an id and partition."""
    held = facts.sparkSession.sparkContext.broadcast((model.ent, model.rel))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ent, rel = held.value
        for batch in batches:
            h, r, t = (np.asarray(batch.column(k)) for k in range(3))
            for kind, at, rows in ((0, t, ent[h] + rel[r]), (1, r, ent[t] - ent[h])):
                ids, place = np.unique(at, return_inverse=True)
                n, d = np.zeros(len(ids)), np.zeros((len(ids), rows.shape[1]))
                np.add.at(n, place, 1.0)
                np.add.at(d, place, rows)
                yield _sums(kind, ids, n, d)

    sums, counts = [model.ent.copy(), np.zeros_like(model.rel)], [np.ones(len(model.ent)), np.zeros(len(model.rel))]
    for row in _summed(facts.select("h", "r", "t").mapInArrow(run, _SUMS)).toLocalIterator():
        sums[row["kind"]][row["id"]] += row["d"]
        counts[row["kind"]][row["id"]] += row["n"]
    return np.maximum(sums[0] / counts[0][:, None], 0), sums[1] / np.maximum(counts[1], 1)[:, None]


def relation_overlap(facts: DataFrame) -> DataFrame:
    """(a, b, share): entities that two relations share, over the largest share of a; the logic attention of relation pairs."""
    ends = facts.select("r", F.col("h").alias("e")).union(facts.select("r", "t")).distinct()
    held = ends.groupBy("e").agg(F.sort_array(F.collect_set("r")).alias("rs"))
    # An entity contributes its relation pairs, of which there are few: relations are a small dictionary.
    pairs = held.select(F.explode("rs").alias("a"), "rs").select("a", F.explode("rs").alias("b")).filter("a <> b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return shared.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy("a"))).drop("n")


def continual(
    snapshots: list[DataFrame], sizes: list[tuple[int, int]], strategy: str, s: Settings | None = None,
    watch: Callable[[int, str, Model], None] | None = None,
) -> Model:
    """A model trained over snapshots of new facts (h, r, t); ``sizes`` are cumulative entities and relations.

    ``watch`` is called with the snapshot's number and ``before`` or ``after`` its training.
    """
    s = s or Settings()
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    model = Model(np.zeros((0, s.dim)), np.zeros((0, s.dim)))
    all_facts: DataFrame | None = None
    for k, (facts, (n_ent, n_rel)) in enumerate(zip(snapshots, sizes, strict=True)):
        _checked(n_ent, n_rel, s)
        facts = stored(facts.select("h", "r", "t"))
        all_facts = facts if all_facts is None else all_facts.union(facts)
        old_e, old_r = model.ent.copy(), model.rel.copy()
        fresh = strategy in ("snapshot_only", "retraining", "cwr") or k == 0
        ent, rel = _rows(n_ent, s.dim, s.seed), _rows(n_rel, s.dim, s.seed + 1)
        if not fresh:
            ent[: len(old_e)], rel[: len(old_r)] = old_e, old_r
        model.ent, model.rel = ent, rel
        if not fresh and strategy in ("mean", "lan"):
            model.ent = neighbour_mean(facts, model, len(old_e), attention=strategy == "lan", seed=s.seed)
        if not fresh and strategy in ("lkge", "dlkge"):
            # New rows are what their facts say of them.
            new_e, new_r = rebuilt(facts, model)
            model.ent[len(old_e) :], model.rel[len(old_r) :] = new_e[len(old_e) :], new_r[len(old_r) :]
        extra = Extra(mask=strategy == "dlkge", track=strategy in ("ewc", "si"))
        if not fresh and strategy == "pnn":
            extra.frozen = (len(old_e), len(old_r))
        if not fresh and strategy in ("ewc", "si"):
            extra.pull = ((model.weight_ent, old_e), (model.weight_rel, old_r))
        if not fresh and strategy in ("lkge", "dlkge"):
            # A row is held back by the share of its facts that are old.
            now = [c[: len(o), None] + 1 for c, o in zip(_counts(facts, n_ent, n_rel), (old_e, old_r), strict=True)]
            shares = [w / (n + w) for w, n in zip((model.weight_ent, model.weight_rel), now, strict=True)]
            extra.pull = ((shares[0] ** 2, old_e), (shares[1] ** 2, old_r))
        if strategy == "gem" and model.memory is not None:
            rows = np.array([tuple(x) for x in model.memory.select("h", "r", "t").toLocalIterator()], np.int64)
            extra.memory = tuple(rows.T) if len(rows) else None
        source = all_facts if strategy == "retraining" else facts
        if strategy == "emr" and model.memory is not None:
            source = facts.union(model.memory)
        if watch is not None:
            watch(k, "before", model)
        before = (model.ent.copy(), model.rel.copy())
        model.tracked = [[np.zeros_like(m), np.zeros_like(m)] for m in before] if extra.track else [[], []]
        losses: list[float] = []
        if strategy in ("lkge", "dlkge"):
            # What facts say of the rows is made anew before each epoch and pulls them in it.
            for epoch in range(s.epochs):
                extra.target = rebuilt(facts, model)
                losses.append(_epoch(source, model, s, epoch, extra))
                if len(losses) > s.patience and min(losses[-s.patience :]) >= min(losses[: -s.patience]):
                    break
        else:
            losses = fit(source, model, s, extra)
        _remember(model, strategy, facts, before, (len(old_e), len(old_r)), (n_ent, n_rel), k, s)
        model.log.append({"snapshot": k, "losses": losses})
        if watch is not None:
            watch(k, "after", model)
    if strategy == "cwr" and model.merged is not None:
        model.ent, model.rel = model.merged
    return model


def _grown(w: np.ndarray | None, n: int, dim: int) -> np.ndarray:
    out = np.zeros((n, dim))
    if w is not None:
        out[: len(w)] = w
    return out


def _remember(model: Model, strategy: str, facts: DataFrame, before: tuple, old: tuple, size: tuple, k: int, s: Settings) -> None:
    """What a strategy keeps of a snapshot for the next ones."""
    if strategy == "cwr":
        ent, rel = model.ent.copy(), model.rel.copy()
        if model.merged is not None:
            # Trained values p and consolidated ones w of before: (p w + p) / (1 + w).
            for new, w in ((ent, model.merged[0]), (rel, model.merged[1])):
                bottom = np.where(np.abs(1 + w) < 1e-9, 1e-9, 1 + w)
                new[: len(w)] = (new[: len(w)] * w + new[: len(w)]) / bottom
        model.merged = (ent, rel)
    elif strategy == "ewc":
        merged = []
        for part, weight, n_old in ((0, model.weight_ent, old[0]), (1, model.weight_rel, old[1])):
            fisher = model.tracked[part][0] / max(facts.count(), 1)
            if weight is not None:
                fisher[:n_old] = (fisher[:n_old] + weight[:n_old] * k + 1) / (k + 2)
            merged.append(fisher)
        model.weight_ent, model.weight_rel = merged
    elif strategy == "si":
        omegas = []
        for part, (now, start, weight) in enumerate(((model.ent, before[0], model.weight_ent), (model.rel, before[1], model.weight_rel))):
            omegas.append(_grown(weight, size[part], s.dim) + model.tracked[part][1] / ((now - start) ** 2 + 0.1))
        model.weight_ent, model.weight_rel = omegas
    elif strategy in ("lkge", "dlkge"):
        e, r = _counts(facts, *size)
        model.weight_ent = _grown(model.weight_ent, size[0], 1) + e[:, None]
        model.weight_rel = _grown(model.weight_rel, size[1], 1) + r[:, None]
    elif strategy in ("emr", "gem"):
        half = s.memory if model.memory is None else s.memory // 2
        new = facts.withColumn("x", F.xxhash64("h", "r", "t", F.lit(s.seed))).orderBy("x", "h", "r", "t").limit(half).drop("x")
        kept = None if model.memory is None else model.memory.withColumn("x", F.xxhash64("t", "r", "h", F.lit(k))).orderBy("x", "h", "r", "t").limit(s.memory - half).drop("x")
        model.memory = stored(new if kept is None else new.union(kept))


def model_tables(spark: SparkSession, model: Model) -> DataFrame:
    """(kind, id, vec) of a model, to be written as Parquet."""
    rows = [(kind, k, v.tolist()) for kind, m in (("entity", model.ent), ("relation", model.rel)) for k, v in enumerate(m)]
    return spark.createDataFrame(rows, "kind string, id bigint, vec array<double>")


def model_from(tables: DataFrame) -> Model:
    """The model that ``model_tables`` wrote."""
    out = {}
    for kind in ("entity", "relation"):
        rows = tables.filter(F.col("kind") == kind).orderBy("id").select("vec")
        out[kind] = np.array([r["vec"] for r in rows.toLocalIterator()], float)
    return Model(out["entity"], out["relation"])


def evaluate(model: Model, facts: DataFrame, known: DataFrame) -> DataFrame:
    """Filtered tail ranks of the facts under the model, as mean rank, mean reciprocal rank and hits."""
    from tracewright.operators.ranking import rank_metrics, ranks

    spark = facts.sparkSession
    tables = stored(model_tables(spark, model))
    ent = tables.filter("kind = 'entity'").select("id", "vec")
    rel = tables.filter("kind = 'relation'").select(F.col("id").alias("r"), F.col("vec").alias("rv"))
    asked = facts.select("h", "r", "t").distinct().withColumn("query_id", F.xxhash64("h", "r", "t"))
    joined = asked.join(ent.select(F.col("id").alias("h"), F.col("vec").alias("hv")), "h").join(rel, "r")
    queries = joined.select("query_id", F.zip_with("hv", "rv", lambda a, b: a + b).alias("query"), F.col("t").alias("target"))
    others = asked.join(known.select("h", "r", F.col("t").alias("id")).distinct(), ["h", "r"]).filter("id <> t").select("query_id", "id")
    return rank_metrics(ranks(queries, ent, others))


def continual_report(snapshots: list[DataFrame], sizes: list[tuple[int, int]], strategy: str, s: Settings | None = None) -> dict[str, object]:
    """Train over all snapshots and report each one's reciprocal rank before, after and at the end, with forward and backward transfer.

    A snapshot is tested on its own facts among the entities known by then; the whole figure weighs snapshots by their facts.
    """
    known = [reduce(DataFrame.union, snapshots[: k + 1]) for k in range(len(snapshots))]
    scores: dict[str, list[float]] = {"before": [], "after": []}

    def watch(k: int, phase: str, model: Model) -> None:
        scores[phase].append(evaluate(model, snapshots[k], known[k]).first()["mrr"])

    model = continual(snapshots, sizes, strategy, s, watch)
    before, first = scores["before"], scores["after"]
    final = [evaluate(model, facts, known[-1]).first()["mrr"] for facts in snapshots]
    weights = [facts.count() for facts in snapshots]
    whole = float(np.average(final, weights=weights)) if sum(weights) else 0.0
    return {"before": before, "first": first, "final": final, "whole": whole, **transfer_report(first, before, final)}


def transfer_report(first: list[float], before: list[float], final: list[float]) -> dict[str, float]:
    """Forward transfer: mean score before a snapshot was trained on; backward: final minus first score of earlier snapshots."""
    past = [b - a for a, b in zip(first[:-1], final[:-1], strict=True)]
    return {"fwt": float(np.mean(before[1:])) if len(before) > 1 else 0.0, "bwt": float(np.mean(past)) if past else 0.0}

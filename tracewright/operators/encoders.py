"""Graph encoders at inference, contrastive losses within a batch, and explanation search.

Training of neural encoders is out of scope; given weights, a layer is a neighbour sum (a join and a
grouped sum) and a matrix product on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordering import global_numbers
from tracewright.operators.vectors import dot, readout


def _product(vectors: DataFrame, keys: list[str], weight: np.ndarray, bias: np.ndarray, relu: bool) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        out = np.stack(v.map(np.asarray).to_list()).astype(float) @ weight + bias
        return pd.Series(list(np.maximum(out, 0) if relu else out))

    return vectors.select(*keys, run("vec").alias("vec"))


def neighbour_sum(nodes: DataFrame, edges: DataFrame, keys: list[str], mean: bool = False, own: float = 1.0) -> DataFrame:
    """Per node: own times its vector plus the sum (or mean) of its neighbours', both directions."""
    both = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select(*keys, "dst", "src"))
    sent = both.join(nodes.select(*keys, F.col("node").alias("other"), "vec"), [*keys, "other"]).select(*keys, "node", "vec")
    gathered = readout(sent, [*keys, "node"], "mean" if mean else "sum").withColumnRenamed("vec", "near")
    joined = nodes.join(gathered, [*keys, "node"], "left")
    total = F.zip_with("vec", "near", lambda a, b: own * a + b)
    return joined.withColumn("vec", F.when(F.col("near").isNull(), F.transform("vec", lambda a: own * a)).otherwise(total)).drop("near")


def attention_layer(nodes: DataFrame, edges: DataFrame, keys: list[str], weight: np.ndarray, source: np.ndarray, target: np.ndarray, slope: float = 0.2) -> DataFrame:
    """(keys, node, vec): neighbours (both directions, and the node itself) weighed by a softmax of leaky-ReLU(source . Wi + target . Wj).

    Only two numbers a node travel along the edges before the softmax; vectors follow with their weights.
    """
    moved = _product(nodes, [*keys, "node"], weight, np.zeros(weight.shape[1]), False)
    side = lambda w: dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in w]))
    scored = moved.select(*keys, "node", "vec", side(source).alias("__s"), side(target).alias("__t"))
    ends = edges.select(*keys, "src", "dst")
    both = ends.select(*keys, F.col("src").alias("node"), F.col("dst").alias("other")).union(ends.select(*keys, "dst", "src"))
    both = both.union(nodes.select(*keys, "node", F.col("node").alias("other"))).distinct()
    own, near = scored.select(*keys, "node", "__s"), scored.select(*keys, F.col("node").alias("other"), "__t", "vec")
    linked = both.join(own, [*keys, "node"]).join(near, [*keys, "other"])
    raw = F.col("__s") + F.col("__t")
    linked = linked.withColumn("__e", F.exp(F.when(raw > 0, raw).otherwise(raw * slope)))
    whole = linked.groupBy(*keys, "node").agg(F.sum("__e").alias("__z"))
    weighed = linked.join(whole, [*keys, "node"]).select(*keys, "node", F.transform("vec", lambda x: x * F.col("__e") / F.col("__z")).alias("vec"))
    return readout(weighed, [*keys, "node"], "sum")


def logits(graphs: DataFrame, key: str, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(key, vec): the class scores of graph vectors by a last layer."""
    return _product(graphs, [key], weight, bias, False)


def encode_graphs(nodes: DataFrame, edges: DataFrame, keys: list[str], layers: list[tuple[np.ndarray, np.ndarray]], pool: str = "sum", mean: bool = False) -> DataFrame:
    """(keys, vec): layer outputs pooled per graph and concatenated."""
    out: DataFrame | None = None
    for k, (weight, bias) in enumerate(layers):
        nodes = _product(neighbour_sum(nodes, edges, keys, mean), [*keys, "node"], weight, bias, True)
        pooled = readout(nodes, keys, pool).withColumnRenamed("vec", f"v{k}")
        out = pooled if out is None else out.join(pooled, keys)
    return out.select(*keys, F.concat(*[F.col(f"v{k}") for k in range(len(layers))]).alias("vec"))


def contrastive(a: np.ndarray, b: np.ndarray, temperature: float = 0.2) -> np.ndarray:
    """Two-direction loss of each row of one batch, matching rows being positive."""
    scale = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim = np.exp(scale(a) @ scale(b).T / temperature)
    good = np.diag(sim)
    one = -np.log(good / np.maximum(sim.sum(1) - good, 1e-12))
    two = -np.log(good / np.maximum(sim.sum(0) - good, 1e-12))
    return (one + two) / 2


def contrastive_by_batch(pairs: DataFrame, key: str, batch: int) -> DataFrame:
    """(key, loss) of (key, a, b) rows; batches are runs of ``batch`` rows in the key's hash order, the last one shorter.

    Rows are numbered first, so a batch is the same however the data is partitioned.
    """
    hashed = pairs.select(key, "a", "b").withColumn("__h", F.xxhash64(key))
    numbered = global_numbers(hashed, ["__h", key], "__n").withColumn("__batch", F.floor(F.col("__n") / batch))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = frame.sort_values("__n")
        a, b = (np.stack(part[c].map(np.asarray).to_list()) for c in ("a", "b"))
        return pd.DataFrame({key: part[key].to_numpy(), "loss": contrastive(a, b)})

    return numbered.groupBy("__batch").applyInPandas(run, f"{key} {pairs.schema[key].dataType.simpleString()}, loss double")


def prototype_similarity(distance: np.ndarray) -> np.ndarray:
    """ln((d + 1) / (d + 1e-4))."""
    return np.log((distance + 1) / (distance + 1e-4))


def class_connections(classes: list[int], n_classes: int, wrong: float = -0.5) -> np.ndarray:
    """(prototypes, classes): 1 to the own class, ``wrong`` to the others."""
    out = np.full((len(classes), n_classes), wrong)
    out[np.arange(len(classes)), classes] = 1.0
    return out


#: Steps in which a search takes a graph apart.
STEPS = 500


class _Node:
    def __init__(self, atoms: tuple[int, ...]) -> None:
        self.atoms, self.children, self.n, self.total, self.prior = atoms, [], 0, 0.0, 0.0


def _largest_part(atoms: set[int], links: dict[int, set[int]]) -> tuple[int, ...]:
    best: set[int] = set()
    left = set(atoms)
    while left:
        found, stack = set(), [min(left)]
        while stack:
            x = stack.pop()
            if x in left:
                left.discard(x)
                found.add(x)
                stack += [y for y in links.get(x, ()) if y in left]
        if len(found) > len(best):
            best = found
    return tuple(sorted(best))


def search_subgraph(vectors: dict[int, np.ndarray], links: dict[int, set[int]], prototype: np.ndarray, max_atoms: int, least: int = 2, rounds: int = 20, explore: float = 5.0, branches: int = 12) -> tuple[tuple[int, ...], float]:
    """The connected part of at most ``max_atoms`` nodes most like a prototype, by tree search with PUCT.

    A step takes a share of the nodes away (one in ``STEPS``, at least one), so that large graphs need not more steps.
    """

    def value(atoms: tuple[int, ...]) -> float:
        centre = sum(vectors[a] for a in atoms)
        return float(prototype_similarity(((centre - prototype) ** 2).sum()))

    known: dict[tuple[int, ...], _Node] = {}
    root = _Node(_largest_part(set(vectors), links))
    known[root.atoms] = root

    def grown(node: _Node) -> None:
        inside = set(node.atoms)
        by_degree = sorted(node.atoms, key=lambda a: (len(links.get(a, set()) & inside), a))
        step = max(1, len(by_degree) // STEPS)
        for low in range(0, min(branches * step, len(by_degree)), step):
            part = _largest_part(inside - set(by_degree[low : low + step]), links)
            if part:
                child = known.setdefault(part, _Node(part))
                child.prior = child.prior or value(part)
                if child not in node.children:
                    node.children.append(child)

    def roll(node: _Node) -> None:
        way = []
        while len(node.atoms) > least:
            if not node.children:
                grown(node)
            whole = sum(c.n for c in node.children)
            node = max(node.children, key=lambda c: ((c.total / c.n if c.n else 0.0) + explore * c.prior * np.sqrt(whole + 1) / (1 + c.n), -len(c.atoms)))
            way.append(node)
        found = value(node.atoms)
        for passed in way:
            passed.n += 1
            passed.total += found

    for _ in range(rounds):
        roll(root)
    fitting = [n for n in known.values() if len(n.atoms) <= max_atoms] or [min(known.values(), key=lambda n: len(n.atoms))]
    top = max(fitting, key=lambda n: (value(n.atoms), -len(n.atoms)))
    return top.atoms, value(top.atoms)


def explain_graphs(nodes: DataFrame, edges: DataFrame, graph: str, prototype: np.ndarray, max_atoms: int) -> DataFrame:
    """(graph, atoms, score) of every graph: a search holds one graph in one task."""
    kind = nodes.schema[graph].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({graph: [], "atoms": [], "score": []})
        vectors = {int(k): np.asarray(v, float) for k, v in zip(a["node"], a["vec"], strict=True)}
        links: dict[int, set[int]] = {}
        for x, y in zip(b["src"], b["dst"], strict=True):
            if x in vectors and y in vectors:
                links.setdefault(int(x), set()).add(int(y))
                links.setdefault(int(y), set()).add(int(x))
        atoms, score = search_subgraph(vectors, links, prototype, max_atoms)
        return pd.DataFrame({graph: [a[graph].iloc[0]], "atoms": [list(atoms)], "score": [score]})

    return nodes.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, atoms array<bigint>, score double")


def agglomerate(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Average-linkage clusters by cosine distance.

    The mean cosine distance of two clusters is had from their sums, 1 - S.T / (m n), so no matrix of
    distances is held. Merges are found along chains of nearest neighbours, which gives the same tree as
    merging the nearest pair first; the lowest merges are then made.
    """
    n = len(vectors)
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    total, size, alive = x.astype(float).copy(), np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            at = chain[-1]
            far = np.where(alive, 1 - total @ total[at] / (size * size[at]), np.inf)
            far[at] = np.inf
            near = int(far.argmin())
            if len(chain) > 1 and far[chain[-2]] <= far[near] + 1e-15:
                near = chain[-2]
                break
            chain.append(near)
        at, near = chain.pop(), chain.pop()
        merges.append((float(far[near]), at, near))
        kept, gone = min(at, near), max(at, near)
        total[kept] += total[gone]
        size[kept] += size[gone]
        alive[gone] = False
    parent = np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.unique([root(k) for k in range(n)], return_inverse=True)[1]


def agglomerative(vectors: DataFrame, keys: list[str], key: str, clusters: int) -> DataFrame:
    """(keys, key, cluster) per group; a group is one task, whose memory grows with its vectors and whose time with their square."""
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in [*keys, key])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(key)
        found = agglomerate(np.stack(ordered["vec"].map(np.asarray).to_list()), clusters)
        return ordered[[*keys, key]].assign(cluster=found.astype("int32"))

    return vectors.groupBy(*keys).applyInPandas(run, f"{kinds}, cluster int")

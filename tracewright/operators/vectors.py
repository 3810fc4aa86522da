"""Scores, losses and distances over (head, relation, tail) vectors, as array expressions.

Element-wise models stay inside the JVM; models with matrices or transforms run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.parsers import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column, p: int = 2) -> Column:
    return total(F.transform(v, F.abs)) if p == 1 else F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """v / max(|v|, 1e-12)."""
    return let(v, lambda a: let(norm(a), lambda n: F.transform(a, lambda x: x / F.greatest(n, F.lit(1e-12)))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scaled(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _half(v: Column, second: bool) -> Column:
    n = F.floor(F.size(v) / 2).cast("int")
    return F.slice(v, n + 1, n) if second else F.slice(v, F.lit(1), n)


def transe(h: Column, r: Column, t: Column, p: int = 1, normalize: bool = True) -> Column:
    if normalize:
        h, r, t = unit(h), unit(r), unit(t)
    return norm(minus(plus(h, r), t), p)


def transh(h: Column, r: Column, t: Column, normal: Column, p: int = 1) -> Column:
    """Distance after both ends are projected onto the relation's hyperplane."""

    def project(e: Column, w: Column) -> Column:
        return let(dot(e, w), lambda k: F.zip_with(e, w, lambda x, y: x - k * y))

    return let(unit(normal), lambda w: transe(project(h, w), r, project(t, w), p))


def transd(h: Column, r: Column, t: Column, hp: Column, rp: Column, tp: Column, p: int = 1) -> Column:
    """Distance after projection by entity and relation vectors: e + (e . ep) rp."""

    def project(e: Column, ep: Column) -> Column:
        return unit(let(dot(e, ep), lambda k: F.zip_with(e, rp, lambda x, y: x + k * y)))

    return transe(project(h, hp), r, project(t, tp), p)


def distmult(h: Column, r: Column, t: Column) -> Column:
    return total(F.zip_with(times(h, r), t, lambda x, y: x * y))


def complex_score(h: Column, r: Column, t: Column) -> Column:
    """Real part of <h, r, conj(t)>; vectors hold real halves before imaginary ones."""
    (hr, hi), (rr, ri), (tr, ti) = [(_half(v, False), _half(v, True)) for v in (h, r, t)]
    return distmult(hr, rr, tr) + distmult(hi, rr, ti) + distmult(hr, ri, ti) - distmult(hi, ri, tr)


def rotate(h: Column, phase: Column, t: Column, margin: float) -> Column:
    """margin - sum |h o e^(i phase) - t| over complex elements."""
    hr, hi, tr, ti = _half(h, False), _half(h, True), _half(t, False), _half(t, True)
    c, s = F.transform(phase, F.cos), F.transform(phase, F.sin)
    real = minus(minus(times(hr, c), times(hi, s)), tr)
    imaginary = minus(plus(times(hr, s), times(hi, c)), ti)
    return F.lit(margin) - total(F.zip_with(real, imaginary, lambda x, y: F.sqrt(x * x + y * y)))


def analogy(h: Column, r: Column, t: Column, hd: Column, rd: Column, td: Column) -> Column:
    return -complex_score(h, r, t) - distmult(hd, rd, td)


def simple_score(h: Column, r: Column, inverse: Column, t: Column) -> Column:
    return (distmult(h, r, t) + distmult(h, inverse, t)) / 2


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.map(np.asarray).to_list()).astype(float) if len(series) else np.zeros((0, 1))


def batched(score: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A column function of array columns from a function of stacked matrices."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(score(*[_stack(c) for c in columns]) if len(columns[0]) else [], dtype=float)

    return run


def _hole(h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (r * np.fft.ifft(np.conj(np.fft.fft(h)) * np.fft.fft(t)).real).sum(1)


def _rescal(h: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
    d = h.shape[1]
    return -np.einsum("ni,nij,nj->n", h, m.reshape(-1, d, d), t)


def _transr(h: np.ndarray, r: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    m = m.reshape(-1, h.shape[1], r.shape[1])
    scale = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.abs(scale(np.einsum("ni,nij->nj", h, m)) + scale(r) - scale(np.einsum("ni,nij->nj", t, m))).sum(1)


def hole(h: Column, r: Column, t: Column) -> Column:
    """<r, circular correlation of h and t>."""
    return batched(_hole)(h, r, t)


def rescal(h: Column, matrix: Column, t: Column) -> Column:
    return batched(_rescal)(h, matrix, t)


def transr(h: Column, r: Column, t: Column, matrix: Column) -> Column:
    return batched(_transr)(h, r, t, matrix)


def predict(score: Column, distance: bool, margin: float | None = None) -> Column:
    """Lower is better: distances undo a margin, products change sign."""
    return (score if margin is None else F.lit(margin) - score) if distance else -score


def regularization(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """Mean of squares and sum of |x|^3 over all elements of a table, without gathering vectors."""
    per = vectors.select(
        F.size(column).alias("n"), total(F.transform(column, lambda x: x * x)).alias("q"),
        total(F.transform(column, lambda x: F.abs(x) * x * x)).alias("c"),
    )
    return per.agg((F.sum("q") / F.sum("n")).alias("mean_square"), F.sum("c").alias("l3"))


def margin_loss(positive: Column, negative: Column, margin: float) -> Column:
    return F.greatest(positive - negative, F.lit(-margin)) + margin


def sigmoid_loss(positive: Column, negative: Column) -> Column:
    return (F.log1p(F.exp(-positive)) + F.log1p(F.exp(negative))) / 2


def softplus_loss(positive: Column, negative: Column) -> Column:
    return (F.log1p(F.exp(-positive)) + F.log1p(F.exp(negative))) / 2


def self_adversarial(negatives: DataFrame, keys: list[str], score: str, temperature: float = 1.0) -> DataFrame:
    """(keys, loss): log(1 + exp(score)) of the negatives of each positive, weighed by the softmax of their scores.

    Sums only, so the negatives of one positive are combined before they are moved.
    """
    e = F.exp(F.col(score) * temperature)
    sums = negatives.groupBy(*keys).agg(F.sum(e * F.log1p(F.exp(F.col(score)))).alias("__a"), F.sum(e).alias("__b"))
    return sums.select(*keys, (F.col("__a") / F.col("__b")).alias("loss"))


def regularization_of(facts: DataFrame, parts: list[str]) -> DataFrame:
    """``reg``: the mean of squares over the vectors of each part (heads, tails, relations) that take part, averaged over the parts."""
    sums = [F.sum(total(F.transform(c, lambda x: x * x))).alias(c) for c in parts]
    sizes = [F.sum(F.size(c)).alias(f"n_{c}") for c in parts]
    whole = sum((F.col(c) / F.col(f"n_{c}") for c in parts[1:]), F.col(parts[0]) / F.col(f"n_{parts[0]}"))
    return facts.agg(*sums, *sizes).select((whole / len(parts)).alias("reg"))


def padded(v: Column, size: int) -> Column:
    """v cut or filled with zeros to ``size``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def factor_blocks(v: Column, factors: int) -> Column:
    """A vector cut into so many blocks of equal length."""
    size = F.floor(F.size(v) / factors).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(factors - 1)), lambda k: F.slice(v, k * size + 1, size))


def top_factors(relation: Column, factors: int, top: int) -> Column:
    """The places of the blocks that a relation attends to most, by their norms, the first of equal ones first."""
    scored = F.transform(factor_blocks(relation, factors), lambda b, k: F.struct((-norm(b)).alias("n"), k.alias("k")))
    return F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, top), lambda s: s["k"]))


def gathered_factors(v: Column, places: Column, factors: int) -> Column:
    """The blocks of a vector at the given places, one after the other."""
    return let(factor_blocks(v, factors), lambda blocks: F.flatten(F.transform(places, lambda k: F.get(blocks, k))))


def unattended(relation: Column, factors: int, top: int) -> Column:
    """The attention mass (softmax of block norms) outside the attended blocks."""
    norms = F.transform(factor_blocks(relation, factors), lambda b: norm(b))
    shares = let(norms, lambda n: let(F.array_max(n), lambda m: let(F.transform(n, lambda x: F.exp(x - m)), lambda e: F.transform(e, lambda x: x / total(e)))))
    return 1 - total(F.slice(F.sort_array(shares, asc=False), 1, top))


def consolidated(new: Column, old: Column) -> Column:
    """Rows of a consolidated model: (p w + p) / (1 + w), p the trained and w the consolidated value before."""
    return F.zip_with(new, old, lambda p, w: (p * w + p) / (1 + w))


def importance_penalty(new: Column, old: Column, importance: Column) -> Column:
    """Sum of importance times the squared change of a row."""
    return total(F.zip_with(importance, minus(new, old), lambda w, d: w * d * d))


def fisher_merged(new: Column, old: Column, snapshot: int) -> Column:
    """Squared gradients of the snapshots so far: (new + old k + 1) / (k + 2)."""
    return F.zip_with(new, old, lambda n, o: (n + o * snapshot + 1) / (snapshot + 2))


def path_importance(omega: Column, path: Column, change: Column, damping: float = 0.1) -> Column:
    """Importance along the way: omega + path / (change^2 + damping)."""
    return plus(omega, F.zip_with(path, change, lambda w, d: w / (d * d + damping)))


def count_penalty(new: Column, old: Column, old_count: Column, new_count: Column) -> Column:
    """Sum of squared changes of a row, weighed by the share of its facts that are old."""
    return total(F.transform(minus(new, old), lambda d: F.pow(d * old_count / (new_count + old_count), 2)))


def gumbel_softmax(logits: Column, noise: Column, temperature: float = 1.0) -> Column:
    """Softmax of logits disturbed by Gumbel noise made of uniform numbers in (0, 1)."""
    raw = F.zip_with(logits, noise, lambda x, u: (x - F.log(-F.log(u))) / temperature)
    return let(raw, lambda z: let(F.array_max(z), lambda m: let(F.transform(z, lambda x: F.exp(x - m)), lambda e: F.transform(e, lambda x: x / total(e)))))


#: Scores by the name of their model; each takes the vectors its model has.
SCORES: dict[str, Callable[..., Column]] = {
    "transe": transe, "transh": transh, "transd": transd, "transr": transr, "distmult": distmult, "complex": complex_score, "rotate": rotate,
    "analogy": analogy, "simple": simple_score, "hole": hole, "rescal": rescal,
}


def element_stats(vectors: DataFrame, keys: list[str], column: str = "vec") -> DataFrame:
    """(keys, i, n, sum, mean, std, max): statistics of each element over the vectors of a key."""
    spread = vectors.select(*keys, F.posexplode(column).alias("i", "v"))
    return spread.groupBy(*keys, "i").agg(
        F.count("v").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max")
    )


def gathered(stats: DataFrame, keys: list[str], value: str, out: str = "vec") -> DataFrame:
    """One row per key: elements back as an array."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    return stats.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias(out))


def readout(vectors: DataFrame, keys: list[str], how: str, column: str = "vec") -> DataFrame:
    """Mean, sum or max of the vectors of each key."""
    return gathered(element_stats(vectors, keys, column), keys, how)


def epsilon(vectors: DataFrame, factor: float = 1.0, column: str = "vec") -> DataFrame:
    """Neighbourhood radius: mean over elements of their standard deviation, times a factor."""
    return element_stats(vectors, [], column).agg((F.avg("std") * factor).alias("eps"))

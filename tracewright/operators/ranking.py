"""Link prediction: ranks of true answers among all entities, metrics, thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates that one task compares at a time.
QUERY_BLOCK, CANDIDATE_BLOCK = 2_000, 20_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _nearer(asked: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each query, how many vectors lie strictly nearer (L1) than ``own``."""
    out = np.zeros(len(asked), np.int64)
    step = max(1, 2_000_000 // max(1, len(vectors)))
    for low in range(0, len(asked) if len(vectors) else 0, step):
        part = asked[low : low + step]
        gap = np.zeros((len(part), len(vectors)))
        for i in range(vectors.shape[1]):
            gap += np.abs(part[:, i, None] - vectors[None, :, i])
        out[low : low + step] = (gap < own[low : low + step, None]).sum(1)
    return out


def ranks(
    queries: DataFrame, entities: DataFrame, known: DataFrame | None = None, block: int = QUERY_BLOCK, candidates: int = CANDIDATE_BLOCK
) -> DataFrame:
    """(query_id, rank, filtered_rank) of (query_id, query, target) among (id, vec), lower L1 distance first.

    Candidates are heads, tails or relations alike: the query is what the target's vector should be.
    The rank is 1 + the candidates strictly nearer than the target. ``known`` (query_id, id) are other
    right answers, which the filtered rank does not count; they are compared one by one, as there are
    few a query. Where queries have a ``kind`` and candidates ``kinds``, ``typed_rank`` and
    ``typed_filtered_rank`` count only candidates of the query's kind (the type constraint).

    Queries and candidates are hashed to blocks of bounded size and every query block meets every
    candidate block once; a meeting gives one count a query, never a pair, and nothing passes the driver.
    """
    typed = "kind" in queries.columns and "kinds" in entities.columns
    kind = ["kind"] if typed else []
    kinds = ["kinds"] if typed else []
    targets = queries.join(entities.select(F.col("id").alias("target"), F.col("vec").alias("tv")), "target")
    distance = F.aggregate(F.zip_with("query", "tv", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    measured = targets.withColumn("own", distance).select("query_id", "query", "own", *kind)
    n_q, n_e = (max(1, -(-t.count() // size)) for t, size in ((queries, block), (entities, candidates)))
    spread = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = measured.withColumn("qb", spread("query_id", n_q)).withColumn("eb", each(n_e))
    right = entities.select("id", "vec", *kinds).withColumn("eb", spread("id", n_e)).withColumn("qb", each(n_q))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        asked, own, vectors = _matrix(a["query"]), a["own"].to_numpy(), _matrix(b["vec"])
        columns = {"query_id": a["query_id"], "n": pa.array(_nearer(asked, own, vectors))}
        if typed:
            n = np.zeros(len(asked), np.int64)
            of = np.array(a["kind"].to_pylist(), object)
            held: dict = {}
            for k, names in enumerate(b["kinds"].to_pylist()):
                for name in names or ():
                    held.setdefault(name, []).append(k)
            for name in set(of.tolist()) & held.keys():
                rows = np.flatnonzero(of == name)
                n[rows] = _nearer(asked[rows], own[rows], vectors[held[name]])
            columns["m"] = pa.array(n)
        return pa.table(columns)

    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, n bigint" + (", m bigint" if typed else "")
    met = left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInArrow(meet, schema)
    ranked = met.groupBy("query_id").agg((F.sum("n") + 1).alias("rank"), *([(F.sum("m") + 1).alias("typed_rank")] if typed else []))
    if known is None:
        return ranked.withColumns({f"{c[:-4]}filtered_rank": F.col(c) for c in ranked.columns[1:]})
    others = known.join(measured, "query_id").join(entities.select("id", F.col("vec").alias("tv"), *kinds), "id")
    fits = F.array_contains("kinds", F.col("kind")) if typed else F.lit(False)
    nearer = others.withColumn("d", distance).filter("d < own").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("k"), F.count(F.when(fits, 1)).alias("kt")
    )
    joined = ranked.join(nearer, "query_id", "left").na.fill(0, ["k", "kt"])
    out = joined.withColumn("filtered_rank", F.col("rank") - F.col("k"))
    if typed:
        out = out.withColumn("typed_filtered_rank", F.col("typed_rank") - F.col("kt"))
    return out.drop("k", "kt")


def link_prediction(test: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, typed: bool = False) -> DataFrame:
    """(side, n, mr, mrr, hits_1, hits_3, hits_10): facts (fact_id, h, r, t) ranked among all heads, then among all tails.

    ``entities`` and ``relations`` have (id, vec); other facts of ``known`` (h, r, t) are not counted. With
    ``typed``, candidates are the entities that the relation was seen with on that side.
    """
    hv, tv = (entities.select(F.col("id").alias(c), F.col("vec").alias(f"{c}v")) for c in "ht")
    joined = test.join(hv, "h").join(tv, "t").join(relations.select(F.col("id").alias("r"), F.col("vec").alias("rv")), "r")
    reports = []
    for side, other, query in (("h", "t", F.zip_with("tv", "rv", lambda a, b: a - b)), ("t", "h", F.zip_with("hv", "rv", lambda a, b: a + b))):
        asked = joined.select(F.col("fact_id").alias("query_id"), query.alias("query"), F.col(side).alias("target"), F.col("r").alias("kind"))
        others = test.select("fact_id", other, "r", F.col(side).alias("__own")).join(known.select(other, "r", F.col(side).alias("id")).distinct(), [other, "r"])
        others = others.filter("id <> __own").select(F.col("fact_id").alias("query_id"), "id")
        candidates = entities
        if typed:
            seen = known.groupBy(F.col(side).alias("id")).agg(F.collect_set("r").alias("kinds"))
            candidates = entities.join(seen, "id", "left")
        ranked = ranks(asked if typed else asked.drop("kind"), candidates, others)
        named = F.lit("head" if side == "h" else "tail").alias("side")
        reports.append(rank_metrics(ranked, "typed_filtered_rank" if typed else "filtered_rank").select(named, "*"))
    return reports[0].unionByName(reports[1])


def rank_metrics(ranked: DataFrame, rank: str = "filtered_rank", hits: tuple[int, ...] = (1, 3, 10), by: list[str] | None = None) -> DataFrame:
    """Mean rank, mean reciprocal rank and hits at k, of all queries or of each value of ``by``."""
    return ranked.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(rank).alias("mr"), F.avg(1 / F.col(rank)).alias("mrr"),
        *[F.avg((F.col(rank) <= k).cast("double")).alias(f"hits_{k}") for k in hits],
    )


def best_threshold(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """The score up to which rows are called positive with most accuracy (lower is positive), and that accuracy.

    Scores are counted first, so the running sums go over distinct scores only.
    """
    from tracewright.operators.ordering import global_running_sum

    counted = scored.groupBy(score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    whole = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(positive)).alias("q")).first()
    n, negatives = whole["n"] or 0, whole["q"] or 0
    running = global_running_sum(counted.withColumn("gain", F.col("p") - F.col("q")), "gain", [score], "gained")
    accuracy = (F.col("gained") + F.lit(negatives)) / F.lit(n)
    best = F.min(F.struct((-accuracy).alias("a"), F.col(score).alias("s"))).alias("b")
    return running.agg(best).select(F.col("b.s").alias("threshold"), (-F.col("b.a")).alias("accuracy"))


def best_thresholds(scored: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """(by, threshold, accuracy): as ``best_threshold`` for every relation; scores of a relation are counted before they are summed in order."""
    counted = scored.groupBy(by, score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    own, order = Window.partitionBy(by), Window.partitionBy(by).orderBy(score)
    right = F.sum(F.col("p") - F.col("q")).over(order) + F.sum("q").over(own)
    judged = counted.withColumn("accuracy", right / F.sum(F.col("p") + F.col("q")).over(own))
    best = F.min(F.struct((-F.col("accuracy")).alias("a"), F.col(score).alias("s"))).alias("b")
    return judged.groupBy(by).agg(best).select(by, F.col("b.s").alias("threshold"), (-F.col("b.a")).alias("accuracy"))


def auc_over_trials(scored: DataFrame, trial: str, score: str, positive: str) -> DataFrame:
    """(n, mean, std) of the area under the ROC curve over trials; trials without both classes have none."""
    counted = scored.groupBy(trial, score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    below = F.sum("q").over(Window.partitionBy(trial).orderBy(score)) - F.col("q") / 2
    per = counted.withColumn("__b", below).groupBy(trial).agg((F.sum(F.col("p") * F.col("__b")) / (F.sum("p") * F.sum("q"))).alias("auc"))
    return per.agg(F.count("auc").alias("n"), F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"))


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties by half; sums run over distinct scores."""
    from tracewright.operators.ordering import global_running_sum

    counted = scored.groupBy(score).agg(F.sum(positive).cast("bigint").alias("p"), F.count(F.lit(1)).alias("n"))
    below = global_running_sum(counted.withColumn("q", F.col("n") - F.col("p")), "q", [score], "upto")
    won = F.sum(F.col("p") * (F.col("upto") - (F.col("n") - F.col("p")) / 2))
    return below.agg((won / (F.sum("p") * F.sum(F.col("n") - F.col("p")))).alias("auc"))


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("rank") <= k)

"""Sources mixed to target shares of the tokens, with capped repeats and the shares reached.

A mix is as large as its scarcest source allows at its most repeats, so that every source that has
documents stands in its target proportion to the others (to within one document); ``total_tokens``
asks for a smaller mix, or for a larger one in which scarce sources fall short. Shares reached are
reported beside the targets; sources without documents reach 0.

Method: documents lie in blocks (by hash, of about ``block_tokens``). Each source's quota is so
many full copies plus a prefix of its blocks in permuted order, the last of them cut at a document.
A splitting tree halves the output shards again and again; at each node the block instances of all
sources are divided by one multivariate hypergeometric draw, so every shard gets exact, disjoint
counts. Block instances then go to shards by their permuted rank, and each shard is shuffled on its own.

Blocks and shards have a fixed size, whatever the size of a mix. The driver holds one row a
(mix, source) of the target table and the top ``TOP_NODES`` nodes of each tree; never documents,
blocks or shards. No window spans more than one slice of a source's blocks (a 4,096th of them), one
block, or one shard. A mix of more than 10^9 block instances fails with numpy's message: take larger blocks.

Defined results: documents with null source or without tokens (null, empty) are in no mix; targets
with null or non-positive share or repeats are reported and get nothing; a source given twice in a
mix counts with the sum of its shares and the most repeats; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.bpe import VOCABULARY, count_tokens
from tracewright.session import stored

BLOCK_TOKENS = 1 << 16
SHARD_TOKENS = 1 << 21
MAX_TARGETS = 10_000
SEED = 20_240_301
#: Leaves of the part of a splitting tree that the driver draws; the rest of each is drawn by a task.
TOP_NODES = 256
#: Slices of the permuted order of one source's blocks; ranks and sums are made within and between them.
SLICE_BITS = 12


def split_node(low: int, high: int, held: np.ndarray, stop: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Nodes of the splitting tree below (low, high) that have at most ``stop`` shards, with what they hold.

    A node draws by its own seed, so that the tree is the same wherever its parts are drawn.
    """
    nodes = [(low, high, held)]
    while nodes:
        low, high, held = nodes.pop()
        if high - low <= stop:
            yield low, high, held
            continue
        middle = (low + high) // 2
        size = int(held.sum()) * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high])
        left = draw.multivariate_hypergeometric(held, size, method="marginals") if held.sum() else held
        nodes += [(middle, high, held - left), (low, middle, left)]


def splitting_tree(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many block instances of each source every shard gets."""
    return np.array([held for _, _, held in split_node(0, shards, np.array(counts, np.int64), 1, seed)])


def shard_quotas(spark: SparkSession, mixes: list[tuple[str, list[str], list[int], int]], seed: int = SEED) -> DataFrame:
    """(mix_id, source, shard, first, last): the ranks of a source's block instances that a shard gets.

    ``mixes`` are (mix, sources, instances of each, shards). The driver draws ``TOP_NODES`` nodes a mix
    at most; each is divided down to its shards by one task, which holds the shards of one node.
    """
    tops = []
    for k, (mix, sources, counts, shards) in enumerate(mixes):
        before = np.zeros(len(counts), np.int64)
        for low, high, held in split_node(0, shards, np.array(counts, np.int64), max(1, -(-shards // TOP_NODES)), seed + k):
            tops.append((mix, sources, low, high, held.tolist(), before.tolist(), seed + k))
            before = before + held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before, out = np.array(row["before"]), []
                for low, _, held in split_node(row["low"], row["high"], np.array(row["held"]), 1, row["seed"]):
                    out += [(row["mix_id"], s, low, b + 1, b + n) for s, b, n in zip(row["sources"], before.tolist(), held.tolist(), strict=True) if n]
                    before = before + held
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _QUOTA, strict=True)], schema=_QUOTA)

    schema = "mix_id string, sources array<string>, low bigint, high bigint, held array<bigint>, before array<bigint>, seed bigint"
    top = spark.createDataFrame(tops, schema).repartition("mix_id", "low")
    return top.mapInArrow(run, "mix_id string, source string, shard bigint, first bigint, last bigint")


_QUOTA = pa.schema([("mix_id", pa.string()), ("source", pa.string()), ("shard", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def permuted(rows: DataFrame, keys: list[str], order: list[str | Column], amount: Column, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``amount`` up to and with each row in the permuted order of its ``keys``.

    The order is cut into slices by the leading bits of its hash; sums are made within each slice and
    over the slices, so that a source of any size is no one task.
    """
    hashed = rows.withColumn("__h", _hash(*order)).withColumn("__slice", F.shiftright("__h", 64 - SLICE_BITS)).withColumn("__a", amount)
    slices = hashed.groupBy(*keys, "__slice").agg(F.sum("__a").alias("__s"))
    along = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("__before", F.coalesce(F.sum("__s").over(along), F.lit(0))).drop("__s")
    names = [c for c in order if isinstance(c, str) and c not in keys]
    inside = Window.partitionBy(*keys, "__slice").orderBy("__h", *names).rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.join(before, [*keys, "__slice"]).withColumn(out, F.col("__before") + F.sum("__a").over(inside))
    return summed.drop("__h", "__slice", "__a", "__before")


def _plan(targets: list, totals: dict[str, tuple[int, int]], total_tokens: int | None, block_tokens: int, shard_tokens: int) -> list[dict]:
    """One row per (mix, source) that gets documents: full copies, rest of the quota, blocks, shards of the mix."""
    mixes: dict[str, dict[str, list[float]]] = {}
    for mix, source, share, repeats in targets:
        if mix is not None and source is not None and (share or 0) > 0 and (repeats or 0) > 0 and source in totals:
            had = mixes.setdefault(mix, {}).setdefault(source, [0.0, 0])
            mixes[mix][source] = [had[0] + share, max(had[1], repeats)]
    rows = []
    for mix, sources in sorted(mixes.items()):
        reach = min(totals[s][0] * r / share for s, (share, r) in sources.items())
        scale = reach if total_tokens is None else total_tokens / sum(share for share, _ in sources.values())
        quotas = {s: min(round(share * scale), totals[s][0] * r) for s, (share, r) in sources.items()}
        shards = int(max(1, round(sum(quotas.values()) / shard_tokens)))
        for source, quota in sorted(quotas.items()):
            have = totals[source][0]
            rows.append(
                {"mix_id": mix, "source": source, "full": quota // have, "rest": quota % have, "shards": shards,
                 "blocks": int(max(1, have // block_tokens))}
            )
    return rows


def _hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns, F.lit(SEED))


def document_sizes(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of named sources that have tokens."""
    named = targets.select("source").filter("source is not null").distinct()
    return count_tokens(
        documents.join(named, "source", "left_semi"), ["doc_id", "source"], vocabulary=vocabulary
    ).filter("n_tokens > 0")


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    vocabulary: str = VOCABULARY,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(mix_id, shard, position, doc_id, copy, source, n_tokens): every document copy of every mix."""
    spark = documents.sparkSession
    sizes = stored(document_sizes(documents, targets, vocabulary)) if sizes is None else sizes
    listed = targets.select("mix_id", "source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    totals = {
        r["source"]: (int(r["t"]), int(r["n"]))
        for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    }
    rows = _plan([tuple(r) for r in listed], totals, total_tokens, block_tokens, shard_tokens)
    plan_schema = "mix_id string, source string, full bigint, rest bigint, shards bigint, blocks bigint"
    plan = F.broadcast(spark.createDataFrame([tuple(r.values()) for r in _ordered(rows)], plan_schema))
    per_source = F.broadcast(
        spark.createDataFrame(sorted({(r["source"], r["blocks"]) for r in rows}), "source string, blocks bigint")
    )
    placed = sizes.join(per_source, "source").withColumn("block", F.pmod(_hash("doc_id"), F.col("blocks"))).drop("blocks")
    blocks = stored(placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))

    # The rest of a quota: whole blocks in permuted order, then documents of the block where it ends.
    own = ["mix_id", "source"]
    ranked = permuted(blocks.join(plan, "source"), own, ["mix_id", "source", "block"], F.col("tokens"), "upto")
    ranked = ranked.withColumn(
        "part",
        F.when(F.col("upto") <= F.col("rest"), "whole").when(F.col("upto") - F.col("tokens") < F.col("rest"), "cut"),
    ).withColumn("left", F.col("rest") - (F.col("upto") - F.col("tokens")))

    # Block instances: every full copy, and the extra one where part is set.
    instances = ranked.select("mix_id", "source", "block", "full", "part", "left").withColumn(
        "copy",
        F.explode(F.filter(F.sequence(F.lit(1), F.col("full") + 1), lambda c: (c <= F.col("full")) | F.col("part").isNotNull())),
    )
    instances = stored(permuted(instances, own, ["mix_id", "source", "block", "copy"], F.lit(1), "rank"))
    counts = {(r["mix_id"], r["source"]): r["n"] for r in instances.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    mixes = []
    for mix in sorted({m for m, _ in counts}):
        sources = sorted(s for m, s in counts if m == mix)
        shards = next(r["shards"] for r in rows if r["mix_id"] == mix)
        mixes.append((mix, sources, [counts[mix, s] for s in sources], shards))
    # One row an instance on both sides: a shard's ranks are counted out and met by an equal rank.
    quota = shard_quotas(spark, mixes).withColumn("rank", F.explode(F.sequence("first", "last"))).drop("first", "last")
    sharded = (
        instances.join(quota, ["mix_id", "source", "rank"])
        .withColumn("cut", F.when(F.col("copy") > F.col("full"), F.when(F.col("part") == "cut", F.col("left"))))
        .select("mix_id", "source", "block", "copy", "shard", "cut")
    )
    members = placed.join(sharded, ["source", "block"])
    # Only the one block where a quota ends is cut; all other instances pass without a window.
    inside = Window.partitionBy("mix_id", "source", "block", "copy").orderBy(_hash("mix_id", "doc_id"), "doc_id")
    part = members.filter("cut is not null").withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = members.filter("cut is null").unionByName(part.filter("upto <= cut").drop("upto"))
    within = Window.partitionBy("mix_id", "shard").orderBy(_hash("doc_id", "copy"), "doc_id", "copy")
    return chosen.withColumn("position", F.row_number().over(within)).select(
        "mix_id", "shard", "position", "doc_id", "copy", "source", "n_tokens"
    )


def _ordered(rows: list[dict]) -> list[dict]:
    names = ["mix_id", "source", "full", "rest", "shards", "blocks"]
    return [{k: r[k] for k in names} for r in rows]


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens, documents, most copies and share reached beside the target share."""
    per_copy = mixed.groupBy("mix_id", "source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most_copies")
    )
    asked = targets.groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    joined = asked.join(per_copy, ["mix_id", "source"], "left").na.fill(0, ["tokens", "copies", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return joined.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))

"""Streaming correlation: sliding buffers, event assembly and online clusters as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.operators.clusters import MicroClusters
from tracewright.session import durable


def correlate_streams(nets: DataFrame, apps: DataFrame, keys: list[str], net_at: str, app_at: str, window: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Pairs of equal keys within the window, of two streams (or two tables, with the same result).

    Watermarks on both sides bound the buffers; records later than the delay are dropped by them.
    """
    n = nets.withWatermark(net_at, delay) if nets.isStreaming else nets
    a = apps.withWatermark(app_at, delay) if apps.isStreaming else apps
    renamed = a.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.expr(f"{net_at} BETWEEN {app_at} - INTERVAL {window} AND {app_at} + INTERVAL {window}")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return n.join(renamed, on).drop(*[f"__{k}" for k in keys])


def session_groups(rows: DataFrame, keys: list[str], at: str, gap: str, delay: str = "10 seconds") -> DataFrame:
    """Runs of records of a key without a longer gap: count, first and last time."""
    marked = rows.withWatermark(at, delay) if rows.isStreaming else rows
    grouped = marked.groupBy(*keys, F.session_window(at, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).drop("w")


def assemble_stream(lines: DataFrame, key: str, at: str, text: str, delay: str = "10 seconds") -> DataFrame:
    """(key, n, lines): the lines of each event id in time order, given out once the watermark has passed them.

    Times are kept with the lines, so that the order does not depend on the batches they came in; lines of
    equal time keep the order of their arrival.
    """

    def collect(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            times, lines = state.get
            state.remove()
            ordered = [line for _, _, line in sorted(zip(times, range(len(lines)), lines, strict=True))]
            yield pd.DataFrame({key: [k[0]], "n": [len(ordered)], "lines": [ordered]})
            return
        times, held = map(list, state.get) if state.exists else ([], [])
        latest = 0
        for batch in batches:
            times += [int(t.value // 1000) for t in batch[at]]
            held += batch[text].tolist()
            latest = max(latest, int(batch[at].max().timestamp() * 1000))
        state.update((times, held))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    kind = lines.schema[key].dataType.simpleString()
    return (
        lines.withWatermark(at, delay)
        .groupBy(key)
        .applyInPandasWithState(
            collect, f"{key} {kind}, n bigint, lines array<string>", "times array<bigint>, lines array<string>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def cluster_stream(vectors: DataFrame, key: str, order: str, eps: float, beta: float, mu: float, decay: float) -> DataFrame:
    """(key, seen, clusters): potential micro-clusters of each key after every batch; their state is all that is kept."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        held = pickle.loads(state.get[0]) if state.exists else MicroClusters(eps, beta, mu, decay)
        for batch in batches:
            for vec in batch.sort_values(order)["vec"]:
                held.add(pd.Series(vec).to_numpy(float))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame({key: [k[0]], "seen": [held.now], "clusters": [len(held.kept)]})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, seen bigint, clusters bigint", "state binary", "update", GroupStateTimeout.NoTimeout
    )


def in_batches(rows: DataFrame, size: int, handle: Callable[[DataFrame, int], None], order: list[str], checkpoint: str) -> StreamingQuery:
    """Start a stream whose rows are handed on in batches of at most ``size`` rows, in order within a micro-batch, with the batch's number.

    ``handle`` gets a DataFrame and (micro-batch, place in it) as one rising number; nothing passes the driver.
    """
    from tracewright.operators.ordering import global_numbers

    def each(batch: DataFrame, epoch: int) -> None:
        numbered = durable(global_numbers(batch, order, "__n"))
        for part in range(-(-numbered.count() // size)):
            handle(numbered.filter((F.col("__n") >= part * size) & (F.col("__n") < (part + 1) * size)).drop("__n"), (epoch << 32) + part)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()

"""Runs of equal consecutive events collapsed to one event with count and duration.

Method: pointer doubling. Every event that matches the one before it points to it; pointers are
replaced by their pointers' pointers until all reach the start of their run, which takes as many
rounds as the longest run's length has binary digits.

Events are range-partitioned by (graph, time, key), so partitions are equally large however busy a
graph or a minute is, and no event is repeated. Within an Arrow batch of a sorted partition a
self-join on the pointer is a gather by position (``double_within``); the first event of a batch
points to the last one of the batch before. Pointers that leave a partition are at most one run a
partition; those are doubled by self-joins of a table with one row a partition
(``double_pointers``). What is handed on is one row a run and batch, already aggregated.

Defined results: repeated deliveries (same ``edge_key``, same content) count once;
edges without ``event_ts``, ``graph_id`` or ``edge_key`` are in no run and come out of no query here;
a null or blank name or call equals nothing and separates its neighbours; equal times are ordered
by ``edge_key``; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import names
from tracewright.session import stored

MAX_GAP_US = 60_000_000
SEGMENT, HEAD, TAIL = range(3)
_COLUMNS = ["edge_key", "graph_id", "us", "subject", "object", "call", "part"]
_OUT = "kind int, part int, root bigint, lo bigint, hi bigint, n bigint, first_us bigint, last_us bigint, graph_id bigint, subject string, object string, call string"
_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("part", pa.int32()), *((c, pa.int64()) for c in ("root", "lo", "hi", "n", "first_us", "last_us", "graph_id")),
        *((c, pa.string()) for c in ("subject", "object", "call")),
    ]
)


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges that have a place in time, in the order of (graph, time, key), with names and calls written one way."""
    timed = edges.filter("edge_key is not null and graph_id is not null and event_ts is not null").select(
        "edge_key",
        "graph_id",
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"),
        "subject_name",
        "object_name",
        "object_type",
        "log_type",
    )
    order = ["graph_id", "us", "edge_key"]
    placed = timed.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    kind, name = F.lower(F.trim("object_type")), names.bare(F.col("object_name"))
    return placed.select(
        *["edge_key", "graph_id", "us"],
        names.bare(F.col("subject_name")).alias("subject"),
        F.when(kind == "file", names.file_path(name)).when(kind == "socket", names.socket(name)).otherwise(name).alias("object"),
        names.call(F.col("log_type")).alias("call"),
        F.spark_partition_id().alias("part"),
    )


def double_within(pointer: np.ndarray) -> np.ndarray:
    """Replace pointers by their pointers' pointers until all have arrived; a start points to itself."""
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            return pointer
        pointer = further


def _equal_before(column: pa.Array, last: object) -> np.ndarray:
    """Whether each value equals the one before it (``last`` before the first); null equals nothing."""
    same = np.zeros(len(column), bool)
    same[0] = last is not None and column[0].as_py() == last
    same[1:] = pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy(zero_copy_only=False)
    return same


def run_segments(ordered: DataFrame, max_gap_us: int = MAX_GAP_US, named: bool = True) -> DataFrame:
    """One row a run and batch (SEGMENT), and the first (HEAD) and last (TAIL) event of every partition.

    ``root`` is the key of the event that the pointers arrived at: the start of the run, or the first
    event of the partition where the run may have begun before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, graph, us, subject, object, call and root of the event before
        part = 0

        def border(kind: int, event: tuple) -> pa.RecordBatch:
            key, graph, us, subject, obj, call, root = event
            row = (kind, part, root, key, key, 1, us, us, graph, subject, obj, call)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            again = _equal_before(batch.column(0), last and last[0])
            batch = batch.filter(pa.array(~again)) if again.any() else batch
            n = batch.num_rows
            if not n:
                continue
            key, graph, us = (batch.column(k).to_numpy() for k in range(3))
            part = batch.column(6)[0].as_py()
            gap = np.diff(us, prepend=us[0] if last is None else last[2])
            matches = gap <= max_gap_us
            for k, column in ((1, 1), (3, 3), (4, 4), (5, 5)):
                matches &= _equal_before(batch.column(column), last and last[k])
            own = np.arange(n)
            pointer = double_within(np.where(matches & (own > 0), own - 1, own))
            starts = np.flatnonzero(pointer == own)
            ends = np.append(starts[1:], n)
            roots = key[starts]
            if matches[0]:
                roots[0] = last[6]  # the event before has arrived: its pointer is taken over
            if last is None:
                yield border(HEAD, (*(batch.column(k)[0].as_py() for k in range(6)), int(key[0])))
            texts = [batch.column(k).take(pa.array(starts)) if named else pa.nulls(len(starts), pa.string()) for k in (3, 4, 5)]
            numbers = [
                roots, np.minimum.reduceat(key, starts), np.maximum.reduceat(key, starts), ends - starts, us[starts], us[ends - 1], graph[starts],
            ]
            kinds = [np.full(len(starts), SEGMENT, np.int32), np.full(len(starts), part, np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, kinds), *(pa.array(c, pa.int64()) for c in numbers), *texts], schema=_ARROW)
            last = (*(batch.column(k)[n - 1].as_py() for k in range(6)), int(roots[-1]))
        if last is not None:
            yield border(TAIL, last)

    return ordered.select(*_COLUMNS).mapInArrow(run, _OUT)


def border_pointers(segments: DataFrame, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """(key, ptr): first events of partitions that match the last event before them, to where that one points."""
    # Two rows a partition: a window over all of them is bounded by the number of tasks.
    order = Window.orderBy("part", "kind")

    def before(name: str) -> Column:
        return F.lag(name).over(order)

    same = (F.col("first_us") - before("first_us")) <= max_gap_us
    for name in ("graph_id", "subject", "object", "call"):
        same &= before(name) == F.col(name)
    borders = segments.filter(F.col("kind") != SEGMENT)
    linked = borders.select("kind", F.col("lo").alias("key"), before("root").alias("ptr"), same.alias("same"))
    return linked.filter((F.col("kind") == HEAD) & F.col("same")).select("key", "ptr")


def double_pointers(members: DataFrame) -> DataFrame:
    """(key, root): follow ``ptr`` from every member (key, ptr) to the key that is no member.

    Every round joins the members with themselves and so halves what is left of every way.
    """
    done = stored(members)
    while True:
        targets = done.select(F.col("key").alias("ptr"), F.col("ptr").alias("next"))
        moved = stored(done.join(targets, "ptr", "left").select("key", F.coalesce("next", "ptr").alias("ptr"), F.col("next").isNotNull().alias("on")))
        done = moved.select("key", "ptr")
        if moved.filter("on").isEmpty():
            return done.withColumnRenamed("ptr", "root")


def _runs(edges: DataFrame, max_gap_us: int, named: bool) -> DataFrame:
    segments = stored(run_segments(ordered_edges(edges), max_gap_us, named))
    roots = double_pointers(border_pointers(segments, max_gap_us))
    inner = segments.filter(F.col("kind") == SEGMENT).join(roots.withColumnRenamed("root", "start"), F.col("root") == F.col("key"), "left")
    names_of = ("graph_id", "subject", "object", "call") if named else ()
    return inner.groupBy(F.coalesce("start", "root").alias("run")).agg(
        F.min("lo").alias("lo_edge_key"),
        F.max("hi").alias("hi_edge_key"),
        *[F.min(c).alias(c) for c in names_of],
        F.sum("n").alias("n_edges"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def collapse_runs(edges: DataFrame, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """One row per run: keys, graph, names, number of edges, first and last time, duration."""
    return _runs(edges, max_gap_us, True).withColumn("duration_us", F.col("last_us") - F.col("first_us"))


def found_runs(edges: DataFrame) -> DataFrame:
    """(lo_edge_key, hi_edge_key) of every run of two or more edges."""
    return _runs(edges, MAX_GAP_US, False).filter("n_edges > 1").select("lo_edge_key", "hi_edge_key")

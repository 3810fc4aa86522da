"""Records of two tables paired by entity with the nearest in time, within a tolerance.

Method: an x-fast trie. The times of an entity are cut into root intervals of 2^bits us; a root's
trie also holds the points that lie within the tolerance outside of it, so a query reads one root
and finds both neighbours in it. Both tables are partitioned once by (entity, root interval) and
sorted, points before queries: a busy entity spreads over its intervals.

The nodes of a trie are numbered (1 << length) | prefix; a hash table maps (root, node number) to
the first and last point below it, so one level is one set of bit prefixes and a probe costs the
same however many points there are. A query finds its longest stored prefix by binary search over
the length, and the missing branch there gives its predecessor and successor, the nearer of which
is taken. Tables are built over ``CHUNK`` points at most (of many small roots, or of a part of a
large one with the point before and after it), all probes of a batch of queries at once.

A task holds the points of one root and a bounded number of queries; equal times of an entity are
one point (the smallest id), which bounds a root by its distinct times.

Defined results: records without usable time, address or number match nothing; repeated deliveries
count once; of equally near records the earlier, then the smaller id; an empty table on either side
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import names

BITS = 25
TOLERANCE_US = 2_000_000
#: Points that one hash table holds at most, and rows read before queries are answered.
CHUNK, ROWS = 1 << 16, 1 << 17
_PAIRS = pa.schema([("query_id", pa.int64()), ("id", pa.int64())])


class HashTable:
    """Open addressing over distinct non-negative integers, filled and probed as whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.mask = (1 << int(2 * len(keys)).bit_length()) - 1
        self.keys = keys
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(31)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of every key among the stored ones, -1 where it is not stored."""
        found = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            there = self.slots[at]
            hit = (there >= 0) & (self.keys[there] == keys[left])
            found[left[hit]] = there[hit]
            on = (there >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & self.mask
        return found


class XFastTrie:
    """Tries of consecutive roots over sorted points (root, low) with low below 2^depth."""

    def __init__(self, root: np.ndarray, low: np.ndarray, depth: int) -> None:
        self.root, self.low, self.depth = root, low, depth
        numbers, first, last = [], [], []
        # From the leaves up, every level has the distinct prefixes of the level below.
        owner, prefix, begin, end = root, low, np.arange(len(low)), np.arange(len(low))
        for length in range(depth, -1, -1):
            if length < depth:
                prefix = prefix >> 1
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (prefix[1:] != prefix[:-1])))
                end = end[np.append(new[1:], len(prefix)) - 1]
                owner, prefix, begin = owner[new], prefix[new], begin[new]
            numbers.append(self._number(owner, prefix, length))
            first.append(begin)
            last.append(end)
        self.first, self.last = np.concatenate(first), np.concatenate(last)
        self.table = HashTable(np.concatenate(numbers))

    def _number(self, root: np.ndarray, prefix: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (root << (self.depth + 1)) | (np.int64(1) << np.int64(length) if np.isscalar(length) else np.left_shift(1, length)) | prefix

    def neighbours(self, root: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(below, above) of every query: positions of the last point at or before it and the first after it, or -1."""
        n = len(low)
        depth = self.depth
        # The prefix of length least is stored, the one of length most + 1 is not.
        least, most = np.full(n, -1), np.full(n, depth)
        deepest = np.full(n, -1)
        while (least < most).any():
            length = (least + most + 1) >> 1
            node = self.table.find(self._number(root, low >> (depth - length), length))
            hit = node >= 0
            on = least < most
            deepest = np.where(hit & on, node, deepest)
            least, most = np.where(hit & on, length, least), np.where(~hit & on, length - 1, most)
        inside, exact = least >= 0, least == depth
        branch = (low >> np.maximum(depth - 1 - least, 0)) & 1
        first, last = self.first[deepest], self.last[deepest]
        # All points below the deepest node lie on the other branch: before the query if it went right.
        right = branch == 1
        below = np.where(exact | right, last, first - 1)
        above = np.where(exact | right, last + 1, first)
        return self._checked(below, inside, root), self._checked(above, inside, root)

    def _checked(self, at: np.ndarray, inside: np.ndarray, root: np.ndarray) -> np.ndarray:
        there = inside & (at >= 0) & (at < len(self.low))
        return np.where(there & (self.root[np.where(there, at, 0)] == root), at, -1)


def answer(points: tuple, queries: tuple, tolerance_us: int, depth: int, chunk: int = CHUNK) -> np.ndarray:
    """The id of the nearest point of every query, -1 where none is near enough.

    ``points`` are (root, low, id), ``queries`` (root, low, sub_ns), both in order; roots count from 0.
    """
    root, low, ids = points
    asked, at, ns = queries
    out = np.full(len(at), -1, np.int64)
    whole, sought = (root << depth) | low, (asked << depth) | at
    for begin in range(0, len(low), chunk):
        # A part of the points answers the queries from its first point on, up to the next part's.
        end = min(begin + chunk, len(low))
        lo = 0 if begin == 0 else np.searchsorted(sought, whole[begin])
        hi = len(sought) if end == len(low) else np.searchsorted(sought, whole[end])
        if lo == hi:
            continue
        a, b = max(begin - 1, 0), min(end + 1, len(low))
        trie = XFastTrie(root[a:b] - root[a], low[a:b], depth)
        below, above = trie.neighbours(asked[lo:hi] - root[a], at[lo:hi])
        # Times of queries may be finer than microseconds; distances are compared in nanoseconds.
        far = np.int64(tolerance_us) * 1000 + 1
        left = np.where(below >= 0, (at[lo:hi] - low[a:b][below]) * 1000 + ns[lo:hi], far)
        right = np.where(above >= 0, (low[a:b][above] - at[lo:hi]) * 1000 - ns[lo:hi], far)
        nearer = np.where(left <= right, below, above)
        out[lo:hi] = np.where(np.minimum(left, right) < far, ids[a:b][nearer], -1)
    return out


def placed_rows(queries: DataFrame, points: DataFrame, tolerance_us: int, bits: int) -> DataFrame:
    """Points (kind 0) and queries (kind 1) as (entity, root, kind, low, id, sub_ns), points also in the roots they are near to.

    ``low`` counts from the tolerance before the root's beginning.
    """
    points = points.na.drop(subset=["entity", "us", "id"])
    queries = queries.na.drop(subset=["entity", "us", "query_id"]).na.fill(0, ["sub_ns"])
    root = F.shiftright("us", bits)
    low = F.col("us").bitwiseAND((1 << bits) - 1) + tolerance_us
    held = F.array(
        F.struct(root.alias("root"), low.alias("low")),
        F.when(low < 2 * tolerance_us, F.struct((root - 1).alias("root"), (low + (1 << bits)).alias("low"))),
        F.when(low >= (1 << bits), F.struct((root + 1).alias("root"), (low - (1 << bits)).alias("low"))),
    )
    spread = points.select("entity", "id", F.explode(F.array_compact(held)).alias("p"))
    left = spread.select("entity", "p.root", F.lit(0).alias("kind"), "p.low", "id", F.lit(0).cast("bigint").alias("sub_ns"))
    asked = queries.select("entity", root.alias("root"), F.lit(1).alias("kind"), low.alias("low"), F.col("query_id").alias("id"), "sub_ns")
    keys = ["entity", "root"]
    return left.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "low", "sub_ns", "id")


def nearest(
    queries: DataFrame, points: DataFrame, tolerance_us: int = TOLERANCE_US, bits: int = BITS, chunk: int = CHUNK, rows: int = ROWS
) -> DataFrame:
    """(query_id, id) from ``queries`` (entity, query_id, us, sub_ns) and ``points`` (entity, us, id).

    Queries that come near no point of their entity have no row.
    """
    if tolerance_us > 1 << bits:
        raise ValueError("the root interval must cover the tolerance")
    depth = ((1 << bits) + 2 * tolerance_us).bit_length()

    def solve(held: np.ndarray) -> pa.RecordBatch:
        """Answers to the queries of consecutive whole roots; columns as in ``placed_rows``."""
        entity, root, kind, low, ids, ns = held
        group = np.cumsum(np.append(0, (np.diff(entity) != 0) | (np.diff(root) != 0)))
        is_point = kind == 0
        first = np.append(True, (np.diff(group) != 0) | (np.diff(low) != 0) | (np.diff(kind) != 0)) & is_point
        asked = ~is_point
        found = answer((group[first], low[first], ids[first]), (group[asked], low[asked], ns[asked]), tolerance_us, depth, chunk)
        hit = found >= 0
        return pa.RecordBatch.from_arrays([pa.array(ids[asked][hit]), pa.array(found[hit])], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, wanted = [], 0, rows
        for batch in batches:
            kept.append(np.array([batch.column(k).to_numpy().astype(np.int64) for k in range(6)]))
            size += batch.num_rows
            if size < wanted:
                continue
            # Points come before the queries of their root, so all queries read so far can be answered;
            # the points of the last root may be asked again.
            held = np.concatenate(kept, axis=1)
            yield solve(held)
            last = held[:, (held[0] == held[0, -1]) & (held[1] == held[1, -1]) & (held[2] == 0)]
            kept, size, wanted = [last], last.shape[1], rows + 2 * last.shape[1]
        if size:
            yield solve(np.concatenate(kept, axis=1))

    return placed_rows(queries, points, tolerance_us, bits).mapInArrow(run, "query_id bigint, id bigint")


def packet_times(netlogs: DataFrame) -> DataFrame:
    """Packets with (us, sub_ns) from their epoch text; unusable texts give nulls."""
    text = F.btrim("net_time", F.lit(" \t\r\n\"'"))
    parts = netlogs.withColumn("__t", F.when(text.rlike(r"^\d{1,11}(\.\d*)?$"), text))
    fraction = F.rpad(F.split_part("__t", F.lit("."), F.lit(2)), 9, "0")
    return parts.withColumns(
        {
            "us": F.split_part("__t", F.lit("."), F.lit(1)).cast("bigint") * 1_000_000 + F.substring(fraction, 1, 6).cast("bigint"),
            "sub_ns": F.substring(fraction, 7, 3).cast("bigint"),
        }
    ).drop("__t")


def found_pairs(netlogs: DataFrame, apachelogs: DataFrame, workers: DataFrame) -> DataFrame:
    """(net_id, app_id): each packet a worker sent with that worker's nearest request record."""
    # The worker table has a fixed size; it is left to the planner, which broadcasts by its measured size.
    known = workers.select(
        F.col("worker_id").cast("bigint").alias("entity"), names.address(F.col("node_ip")).alias("ip"),
        F.col("pid").cast("bigint").alias("pid"), F.col("s_port").cast("bigint").alias("port"),
    )
    by_port = known.filter("entity is not null").groupBy("ip", "port").agg(F.min("entity").alias("entity"))
    by_pid = known.filter("entity is not null").groupBy("ip", "pid").agg(F.min("entity").alias("entity"))
    sent = (
        packet_times(netlogs.select("net_id", "net_time", "s_ip", "s_port"))
        .filter("us is not null and net_id is not null")
        .select("net_id", "us", "sub_ns", names.address(F.col("s_ip")).alias("ip"), names.number(F.col("s_port")).alias("port"))
        .join(by_port, ["ip", "port"])
        .select("entity", F.col("net_id").alias("query_id"), "us", "sub_ns")
    )
    served = (
        apachelogs.filter("app_time is not null and app_id is not null")
        .select(
            F.col("app_id").alias("id"), F.unix_micros(F.col("app_time").cast("timestamp")).alias("us"),
            names.address(F.col("dst_ip")).alias("ip"), names.number(F.col("pid")).alias("pid"),
        )
        .join(by_pid, ["ip", "pid"])
        .select("entity", "us", "id")
    )
    pairs = nearest(sent, served)
    # A repeated delivery asks the same again.
    return pairs.groupBy(F.col("query_id").alias("net_id")).agg(F.min("id").alias("app_id"))

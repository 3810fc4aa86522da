"""Joins of application and network records: intervals, as-of, first and last match, ranks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import packed


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """Rows of equal ``keys`` with left_at + low <= right_at <= left_at + high, as an equi-join on buckets.

    Each right row lies in one bucket of the interval's width and each left row looks at the two or
    three that its interval touches, so no side is compared with all of the other.
    """
    width = max(1, high - low)
    bucket_l = F.explode(F.sequence(F.floor((F.col(left_at) + low) / width), F.floor((F.col(left_at) + high) / width)))
    near = left.withColumn("__b", bucket_l)
    held = right.withColumn("__b", F.floor(F.col(right_at) / width))
    within = (F.col(right_at) >= F.col(left_at) + low) & (F.col(right_at) <= F.col(left_at) + high)
    joined = near.join(held, [*keys, "__b"]).filter(within).drop("__b")
    if how == "inner":
        return joined
    return left.join(joined.select(*keys, left_at, *[c for c in joined.columns if c not in left.columns]), [*keys, left_at], "left")


def time_score(a: Column, b: Column) -> Column:
    """ln(1 + 1 / (|a - b| + 1e-9))."""
    return F.log1p(1 / (F.abs(a - b) + 1e-9))


def best_score_join(events: DataFrame, candidates: DataFrame, keys: list[str], event_id: str, event_at: str, candidate_id: str, candidate_at: str, window: int, score: Column | None = None) -> DataFrame:
    """For every event, the candidate within the window of highest score; equal scores keep the first candidate."""
    value = time_score(F.col(event_at), F.col(candidate_at)) if score is None else score
    joined = range_join(events, candidates, keys, event_at, candidate_at, -window, window)
    best = F.min(F.struct((-value).alias("s"), F.col(candidate_id).alias("c")))
    return joined.groupBy(*keys, event_id).agg(best.alias("b")).select(
        *keys, event_id, F.col("b.c").alias(candidate_id), (-F.col("b.s")).alias("score")
    )


def visible_together(a_at: Column, b_at: Column, start: Column, last_tick: Column, window: int) -> Column:
    """Whether two records are buffered at one tick (integer seconds): the batch form of the sliding buffer."""
    later, earlier = F.greatest(a_at, b_at), F.least(a_at, b_at)
    floor = start + F.floor(later - start)
    return (floor + 1 <= last_tick) & (floor - earlier <= window)


def any_match(nets: DataFrame, apps: DataFrame, pairs: list[tuple[list[str], list[str]]], net_id: str, app_order: str, last: bool = False) -> DataFrame:
    """Disjunctive match: nets and apps meet if any column pair is equal; the first (or last) app wins.

    Every alternative is its own equi-join, so the disjunction needs no nested loop.
    """
    parts = []
    for net_columns, app_columns in pairs:
        on = reduce(lambda a, b: a & b, [F.col(f"n.{x}") == F.col(f"a.{y}") for x, y in zip(net_columns, app_columns, strict=True)])
        # One app a key is enough, which keeps hot keys from multiplying.
        pick = F.max if last else F.min
        reduced = apps.groupBy(*app_columns).agg(pick(app_order).alias(app_order))
        parts.append(nets.alias("n").join(reduced.alias("a"), on).select(F.col(f"n.{net_id}").alias(net_id), F.col(f"a.{app_order}").alias(app_order)))
    together = reduce(DataFrame.union, parts)
    return together.groupBy(net_id).agg((F.max if last else F.min)(app_order).alias(app_order))


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_at: str, right_id: str, right_at: str) -> DataFrame:
    """For every left row the first right row of its keys at or after it: one sort of both sides together."""
    ask = left.select(*keys, F.col(left_at).alias("__t"), F.lit(0).alias("__side"), F.col(left_id).alias("__l"), F.lit(None).cast(right.schema[right_id].dataType).alias("__r"))
    have = right.select(*keys, F.col(right_at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(left.schema[left_id].dataType).alias("__l"), F.col(right_id).alias("__r"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__r").rowsBetween(0, Window.unboundedFollowing)
    found = ask.unionByName(have).withColumn("__f", F.first("__r", True).over(order))
    return found.filter("__side = 0").select(*keys, F.col("__l").alias(left_id), F.col("__f").alias(right_id))


def first_and_last(rows: DataFrame, keys: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """The first and the last rows of each key, with ``end`` saying which they are."""
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    numbered = rows.withColumns({"rank_first": F.row_number().over(up), "rank_last": F.row_number().over(down)})
    return numbered.filter((F.col("rank_first") <= first) | (F.col("rank_last") <= last))


def rank_to_rank(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th left row of a key with its k-th right row."""
    a = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "rank"])


def first_port_label(nets: DataFrame, net_seq: str, source: str, target: str, listed: Column) -> DataFrame:
    """Offline rule: listed nets number their source ports; a net's label is the first number of its source, else target, port."""
    ports = nets.filter(listed).groupBy(F.col(source).alias("port")).agg(F.min(net_seq).alias("label"))
    by_source = ports.select(F.col("port").alias(source), F.col("label").alias("__s"))
    by_target = ports.select(F.col("port").alias(target), F.col("label").alias("__t"))
    joined = nets.join(by_source, source, "left").join(by_target, target, "left")
    return joined.withColumn("label", F.coalesce("__s", "__t")).drop("__s", "__t")


def parent_names(processes: DataFrame) -> DataFrame:
    """Process rows (pid, ppid, name, seq) with the name of the parent, else of the grandparent."""
    known = processes.filter("name is not null").groupBy("pid").agg(F.min_by("name", "seq").alias("__n"))
    up = processes.groupBy("pid").agg(F.min_by("ppid", "seq").alias("__pp"))
    one = known.select(F.col("pid").alias("ppid"), F.col("__n").alias("parent"))
    grand = up.join(known.select(F.col("pid").alias("__pp"), F.col("__n").alias("grandparent")), "__pp", "left")
    two = grand.select(F.col("pid").alias("ppid"), "grandparent")
    joined = processes.join(one, "ppid", "left").join(two, "ppid", "left")
    return joined.withColumn("parent", F.coalesce("parent", "grandparent")).drop("grandparent")


def synthetic_clones(runs: DataFrame, clones: DataFrame, names: DataFrame, order: list[str], dull: list[str]) -> DataFrame:
    """Started programs (pid, ppid, name) with the clone edge from their parent that the record lacks.

    Only parents that cloned (``clones``: pid, child) get one. A parent is called by the first name seen for
    it in ``names`` (pid, name), else by that of the process that cloned it; edges from a program of
    ``dull`` to itself are left out.
    """
    first = F.struct(*order)
    known = names.filter("name is not null").groupBy("pid").agg(F.min_by("name", first).alias("parent_name"))
    above = clones.groupBy(F.col("child").alias("ppid")).agg(F.min_by("pid", first).alias("__up"))
    grand = above.join(known.select(F.col("pid").alias("__up"), F.col("parent_name").alias("__grand")), "__up").select("ppid", "__grand")
    joined = runs.join(clones.select(F.col("pid").alias("ppid")).distinct(), "ppid", "left_semi")
    joined = joined.join(known.withColumnRenamed("pid", "ppid"), "ppid", "left").join(grand, "ppid", "left")
    joined = joined.withColumn("parent_name", F.coalesce("parent_name", "__grand")).drop("__grand")
    same = F.coalesce((F.col("name") == F.col("parent_name")) & F.col("name").isin(dull), F.lit(False))
    return joined.filter(~same).withColumn("action", F.lit("sys_clone"))


def _token(value: bytes) -> bytes:
    """A value as it stands in the text of a unit's values, where each ends in a comma."""
    return value.replace(b"%", b"%25").replace(b",", b"%2C")


def _joined(values: Iterable[bytes | None]) -> bytes:
    """Values as one text; nulls are left out."""
    return b"".join(_token(v) + b"," for v in values if v is not None)


def _owned(batches: Iterator[pa.RecordBatch], window: int, width: int) -> Iterator[pa.RecordBatch]:
    """Units with the records of their owner, for each bucket that they touch. Rows come by owner, its records before its units."""
    own, at, held, times, text, n = object(), [], [], np.array([], np.int64), None, 0
    for batch in batches:
        if not len(batch):
            continue
        by, side, t = batch["__by"], batch["__side"].to_numpy(), batch["__t"].fill_null(0).to_numpy()
        known, values, owned = batch["__t"].is_valid().to_numpy(zero_copy_only=False), batch["__v"].to_pylist(), batch["__own"].to_pylist()
        ends, apps = _apps(batch["__apps"])
        some = np.diff(ends) > 0
        low, high = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        low[some], high[some] = apps[ends[:-1][some]] - window, apps[ends[1:][some] - 1] + window
        rows: list[int] = []
        marks: list[np.ndarray] = []
        texts: list[bytes] = []
        totals: list[int] = []
        count, start = 0, 0
        for end in pc.run_end_encode(by).run_ends.to_pylist():
            key = by[start].as_py()
            if key != own:
                own, at, held, text = key, [], [], None
            k = start + int(np.searchsorted(side[start:end], 1))
            if k > start:
                at.append(t[start:k][known[start:k]])
                held += values[start:k]
            if k < end and text is None:
                distinct = set(held)
                times, n, text = np.unique(np.concatenate([times[:0], *at])), len(distinct), _joined(sorted(distinct - {None}))
            # A record farther off than the span is long is the nearest one to no event in it.
            first = np.searchsorted(times, 2 * low[k:end] - high[k:end]).tolist()
            last = np.searchsorted(times, 2 * high[k:end] - low[k:end], "right").tolist()
            for r, i, j in zip(range(k, end), first, last, strict=True):
                total = len(owned[r]) + n
                if some[r] and total:
                    mark = apps[ends[r] : ends[r + 1]]
                    rows.append(r)
                    marks.append(mark if i == j else np.union1d(mark, times[i:j]))
                    texts.append(_joined(owned[r]) + text)
                    totals.append(total)
                    count += len(marks[-1]) + len(text)
                    if count > _CELLS:
                        yield _spread(batch, low, high, rows, marks, texts, totals, width)
                        rows, marks, texts, totals, count = [], [], [], [], 0
            start = end
        if rows:
            yield _spread(batch, low, high, rows, marks, texts, totals, width)


def _apps(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the times of each row end, after a 0, and the times: of each row sorted, each once and without nulls."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[flat.is_valid().to_numpy(zero_copy_only=False)]
    times = flat.drop_null().to_numpy()
    order = np.lexsort((times, row))
    times = times[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (times[1:] != times[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(row[once], minlength=len(lists)))]), times[once]


def _spread(batch: pa.RecordBatch, low: np.ndarray, high: np.ndarray, rows: list[int], marks: list[np.ndarray], texts: list[bytes], totals: list[int], width: int) -> pa.RecordBatch:
    """Each unit of ``rows`` once for each bucket that it touches; its end and its marks count from its begin."""
    t, high = low[rows], high[rows]
    times = high // width - t // width + 1
    each = np.repeat(np.arange(len(rows)), times)
    bucket = t[each] // width + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    sizes = np.array([len(m) for m in marks])
    mark = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(marks) - np.repeat(t, sizes)))
    made = {"__side": pa.array(np.zeros(len(rows), np.int32)), "__t": pa.array(t), "__span": pa.array(high - t), "__a": pa.array(totals, pa.int64()), "__marks": mark, "__values": pa.array(texts, pa.binary())}
    made |= {c: batch[c].take(pa.array(rows, pa.int64())) for c in ("label", "payload")}
    return pa.RecordBatch.from_pydict({"__b": pa.array(bucket)} | {c: v.take(pa.array(each)) for c, v in made.items()})


class _Units:
    """The units of work of one bucket, cut where another of their records becomes the nearest one, by their begin."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: rows[c].to_numpy()
        self.label, begin, total = rows["label"].combine_chunks(), column("__t"), column("__a")
        end = begin + column("__span")
        rank = np.empty(len(rows), np.int64)
        rank[pc.array_sort_indices(self.label)] = np.arange(len(rows))
        marks = rows["__marks"].combine_chunks()
        mark, sizes = marks.flatten().to_numpy(), pc.list_value_length(marks).to_numpy()
        unit = np.repeat(np.arange(len(rows)), sizes)
        mark = mark + begin[unit]
        same, half = unit[1:] == unit[:-1], (mark[1:] - mark[:-1]) // 2 + mark[:-1]
        low, high = begin[unit], end[unit]
        low[1:][same] = np.maximum(low[1:], half + 1)[same]
        high[:-1][same] = np.minimum(high[:-1], half)[same]
        order = np.flatnonzero(low <= high)
        order = order[np.argsort(low[order], kind="stable")]
        self.unit, self.mark, self.low, self.high = unit[order], mark[order], low[order], high[order]
        self.last, self.rank, self.total = np.maximum.accumulate(self.high), rank[self.unit], total[self.unit].astype(np.float64)
        self.codes: dict[bytes, int] = {}
        held = [[self.codes.setdefault(v, len(self.codes)) for v in text.split(b",")[:-1]] for text in rows["__values"].to_pylist()]
        held = [held[u] for u in self.unit.tolist()]
        self.ends = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
        self.values = np.fromiter(chain.from_iterable(held), np.int64, self.ends[-1])
        self.row = np.full(len(self.codes) + 1, -1)
        known: dict[bytes | None, int] = {}
        payload = np.array([known.setdefault(p, len(known)) for p in rows["payload"].to_pylist()], np.int64)
        self.payload, self.payloads = payload[self.unit], list(known)
        self.inside: dict[bytes, np.ndarray] = {}

    def in_payloads(self, value: bytes, prefix: bytes) -> np.ndarray:
        """Which payloads hold what is left of the value without the prefix."""
        rest = value.removeprefix(prefix)
        if rest not in self.inside:
            if len(self.inside) * len(self.payloads) > _REMEMBERED:
                self.inside.clear()
            self.inside[rest] = np.array([rest != b"" and p is not None and rest in p for p in self.payloads])
        return self.inside[rest]

    def counts(self, texts: list[bytes | None], first: int, end: int, prefix: bytes) -> np.ndarray:
        """How often each text is among the values of each piece of ``first`` to ``end``, 1 at least where the payload holds it."""
        codes = np.array([len(self.codes) if x is None else self.codes.get(_token(x), len(self.codes)) for x in texts])
        self.row[codes] = np.arange(len(texts))
        self.row[-1] = -1
        row = self.row[self.values[self.ends[first] : self.ends[end]]]
        piece = np.repeat(np.arange(end - first), np.diff(self.ends[first : end + 1]))
        self.row[codes] = -1
        there = row >= 0
        counted = np.bincount(row[there] * (end - first) + piece[there], minlength=len(texts) * (end - first)).reshape(len(texts), -1)
        for k, text in enumerate(texts):
            if text is not None:
                np.maximum(counted[k], self.in_payloads(text, prefix)[self.payload[first:end]], out=counted[k])
        return counted.astype(np.int32)

    def best(self, events: pa.RecordBatch, prefix: bytes) -> Iterator[pa.RecordBatch]:
        """The best unit of each event; events come in the order of their times."""
        at = events["__t"].to_numpy()
        both = pa.chunked_array([events["subject"], events["object"]]).combine_chunks().dictionary_encode("encode")
        texts, codes = both.dictionary.to_pylist(), both.indices.to_numpy().reshape(2, -1)
        todo = [(k, min(k + _BLOCK, len(at))) for k in range(0, len(at), _BLOCK)]
        found: list[tuple[np.ndarray, ...]] = []
        while todo:
            i, j = todo.pop()
            first, end = np.searchsorted(self.last, at[i]), np.searchsorted(self.low, at[j - 1], "right")
            if (j - i) * (end - first) > _CELLS and j - i > 1:
                todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
                continue
            for k in range(first, end, _CELLS):
                found.append(self.scored(np.arange(i, j), at[i:j], codes[:, i:j], texts, k, min(k + _CELLS, end), prefix))
        if found:
            event, piece, b, hits = (np.concatenate(x) for x in zip(*found, strict=True))
            unit = pa.array(self.unit[piece])
            yield pa.RecordBatch.from_arrays(
                [events["event_id"].take(pa.array(event)), self.label.take(unit), *(pa.array(x, pa.int64()) for x in (np.abs(at[event] - self.mark[piece]), b, hits, self.total[piece].astype(np.int64)))],
                ["event_id", "label", "near", "b", "hits", "a"],
            )

    def scored(self, event: np.ndarray, at: np.ndarray, codes: np.ndarray, texts: list, first: int, end: int, prefix: bytes) -> tuple[np.ndarray, ...]:
        """(event, piece, b, hits) of the best piece of ``first`` to ``end``: one cell for each event and piece, pieces by label."""
        used, code = np.unique(codes, return_inverse=True)
        by_label = np.argsort(self.rank[first:end])
        piece = by_label + first
        counted = self.counts([texts[k] for k in used], first, end, prefix)[:, by_label]
        subject, object_ = code.reshape(2, -1)
        b = counted[subject] + counted[object_]
        cell = np.flatnonzero((b > 0) & (at[:, None] >= self.low[piece]) & (at[:, None] <= self.high[piece]))
        x, y = np.divmod(cell, len(piece))
        seen = counted > 0
        hits = seen[subject[x], y].astype(np.int64) + seen[object_[x], y]
        near = np.abs(at[x] - self.mark[piece][y])
        score = np.full(b.shape, -np.inf)
        score.ravel()[cell] = np.log1p(1 / (near / 1000 + 1e-9)) + hits / 2 * np.exp(b.ravel()[cell] / self.total[piece][y])
        # The first of equal scores is that of the first label.
        top = score.argmax(1)
        own = np.flatnonzero(score[np.arange(len(at)), top] > -np.inf)
        top = top[own]
        return event[own], piece[top], b[own, top], seen[subject[own], top].astype(np.int64) + seen[object_[own], top]


#: Events scored at once, cells (event and piece of a unit) at most, and cells (text and payload) that are remembered.
_BLOCK, _CELLS, _REMEMBERED = 128, 1 << 20, 1 << 26


def best_labels(events: DataFrame, units: DataFrame, nets: DataFrame, window: int, prefix: str = "", by: str = "label") -> DataFrame:
    """(event_id, label, s1, s2): for every event the unit of work that scores most, s1 + s2; the first label wins ties.

    ``events`` have (event_id, at, subject, object) in microseconds, ``units`` (label, ``by``, app_at, payload,
    own) with the times of one or more application records and their values, ``nets`` (``by``, at, v) the
    network records that all units of one ``by`` have. Units are candidates from ``window`` before their first
    to ``window`` after their last application record. s1 is the time score in milliseconds to the nearest of
    application and network records; s2 is I exp((B1 + B2) / A): A the unit's number of values (each of ``own``,
    and once each of ``nets``), B1 and B2 how often subject and object are among them (at least 1 where the
    payload holds them), I the share of the two that are; units with s2 = 0 are none.

    Network records and units meet by owner, then events and units in buckets of time, both shuffled as packed
    columns. Pairs are scored where they meet and only the best of an event goes on, so what is shuffled grows
    with the rows and not with the pairs.
    """
    width = max(1, 8 * window)
    key = F.hash("__by").alias("__key")
    records = nets.filter(F.col(by).isNotNull()).select(F.col(by).alias("__by"), F.lit(0).alias("__side"), F.col("at").cast("bigint").alias("__t"), F.col("v").cast("binary").alias("__v"))
    works = units.filter("label is not null and own is not null").select(
        F.col(by).alias("__by"), F.lit(1).alias("__side"), "label", F.col("payload").cast("binary").alias("payload"), F.col("own").cast("array<binary>").alias("__own"), F.col("app_at").cast("array<bigint>").alias("__apps"),
    )
    asked = events.filter("at is not null").select(
        F.floor(F.col("at") / width).alias("__b"), F.lit(1).alias("__side"), F.col("at").cast("bigint").alias("__t"), "event_id", F.col("subject").cast("binary").alias("subject"), F.col("object").cast("binary").alias("object"),
    )
    kind = {f.name: f.dataType.simpleString() for f in [*works.schema, *asked.schema]}
    owned = packed.shuffled(
        [(records.select("*", key), None), (works.select("*", key), None)],
        f"__by {kind['__by']}, __side int, __t bigint, __v binary, label {kind['label']}, payload binary, __own array<binary>, __apps array<bigint>",
        "__key", ["__by", "__side"], ["__side", "__by"],
    )
    met = packed.shuffled(
        [(owned, lambda batches: _owned(batches, window, width)), (asked, None)],
        f"__b bigint, __side int, __t bigint, __span bigint, label {kind['label']}, payload binary, __a bigint, __marks array<bigint>, __values binary, event_id {kind['event_id']}, subject binary, object binary",
        "__b", ["__b", "__side", "__t"], ["__side", "__b", "__t"],
    )
    start = prefix.encode()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, index = None, [], None
        for batch in batches:
            b, side = batch["__b"].to_numpy(), batch["__side"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(b) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if b[i] != bucket:
                    bucket, parts, index = b[i], [], None
                if side[i] == 0:
                    parts.append(batch.slice(i, j - i))
                elif parts:
                    index = index or _Units(parts)
                    yield from index.best(batch.slice(i, j - i), start)

    pairs = met.mapInArrow(fold, f"event_id {kind['event_id']}, label {kind['label']}, near bigint, b bigint, hits bigint, a bigint")
    s1, s2 = F.log1p(1 / (F.col("near") / 1000 + 1e-9)), F.col("hits") / 2 * F.exp(F.col("b") / F.col("a"))
    best = F.min(F.struct((-(s1 + s2)).alias("s"), "label", "near", "b", "hits", "a")).alias("best")
    # Scores are made after the shuffle, where they are as many bytes again.
    return pairs.repartition("event_id").groupBy("event_id").agg(best).select("event_id", "best.*").select("event_id", "label", s1.alias("s1"), s2.alias("s2"))


def overwrites(records: DataFrame, history: str) -> DataFrame:
    """(label, n): how often a label was the last but one of a record's history, the one that the last took the place of."""
    long = records.filter(F.size(history) >= 2)
    return long.groupBy(F.element_at(history, -2).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def mismatched(records: DataFrame, units: DataFrame, label: str, value: str, own: str) -> DataFrame:
    """Records whose value differs from that of their unit; both are compared as texts."""
    return records.join(units, label).filter(F.col(value).cast("string") != F.col(own).cast("string"))


def key_relevance(events: DataFrame, units: DataFrame, label: str, value: str, subject: str, object_: str) -> DataFrame:
    """exp(B / A): A the unit's histogram total, B the counts of the event's subject and object in it."""
    histogram = units.groupBy(label, value).agg(F.count(F.lit(1)).alias("n"))
    whole = histogram.groupBy(label).agg(F.sum("n").alias("a"))
    s = histogram.select(label, F.col(value).alias(subject), F.col("n").alias("bs"))
    o = histogram.select(label, F.col(value).alias(object_), F.col("n").alias("bo"))
    joined = events.join(s, [label, subject], "left").join(o, [label, object_], "left").join(whole, label, "left")
    b1, b2 = F.coalesce("bs", F.lit(0)), F.coalesce("bo", F.lit(0))
    hits = ((b1 > 0).cast("int") + (b2 > 0).cast("int")) / 2
    return joined.withColumn("relevance", F.when(F.col("a") > 0, hits * F.exp((b1 + b2) / F.col("a")))).drop("bs", "bo", "a")

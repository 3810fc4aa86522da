"""Order-dependent operators: global numbers and sums, islands, slices, carried values, boundary queues.

A number or running sum over a whole table never goes through one task: rows are range-partitioned
by the order, the sorted partitions are written once, and each partition's offset comes from the
partition totals, of which the driver sees one row a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import durable

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def _sorted_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    kept = durable(spread).withColumn("__m", F.monotonically_increasing_id())
    return kept.withColumns({"__part": F.shiftright("__m", _ROW_BITS), "__row": F.col("__m").bitwiseAND((1 << _ROW_BITS) - 1)})


def _offsets(parts: DataFrame, amount: Column) -> DataFrame:
    totals = {r["__part"]: r["a"] for r in parts.groupBy("__part").agg(amount.alias("a")).collect()}
    rows, so_far = [], 0
    for part in sorted(totals):
        rows.append((part, so_far))
        so_far += totals[part] or 0
    real = any(isinstance(a, float) for a in totals.values())
    typed = [(part, float(before) if real else int(before)) for part, before in rows]
    return F.broadcast(parts.sparkSession.createDataFrame(typed, f"__part bigint, __before {'double' if real else 'bigint'}"))


def global_numbers(rows: DataFrame, order: list[str], out: str = "number", start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the order of the columns, which must be unique together."""
    parts = _sorted_parts(rows, order)
    numbered = parts.join(_offsets(parts, F.count(F.lit(1))), "__part")
    return numbered.withColumn(out, F.col("__before") + F.col("__row") + start).drop("__m", "__part", "__row", "__before")


def global_running_sum(rows: DataFrame, value: str, order: list[str], out: str = "running") -> DataFrame:
    """Sum of ``value`` over all rows up to and with this one; nulls count as 0."""
    parts = _sorted_parts(rows.withColumn(value, F.coalesce(F.col(value), F.lit(0))), order)
    within = F.sum(value).over(Window.partitionBy("__part").orderBy("__row"))
    summed = parts.withColumn("__w", within).join(_offsets(parts, F.sum(value)), "__part")
    return summed.withColumn(out, F.col("__w") + F.col("__before")).drop("__m", "__part", "__row", "__before", "__w")


def absolute_times(rows: DataFrame, delta: str, order: list[str], anchor_row: Column, anchor: float, out: str = "at") -> DataFrame:
    """Times from deltas: prefix sums shifted so that the anchor row lies at ``anchor``."""
    summed = durable(global_running_sum(rows, delta, order, "__sum"))
    shift = summed.filter(anchor_row).agg(F.min("__sum")).first()[0]
    return summed.withColumn(out, F.col("__sum") + F.lit(anchor - (shift or 0))).drop("__sum")


def time_slices(rows: DataFrame, order: list[str], slices: int = 4, out: str = "slice") -> DataFrame:
    """Equal slices by position; the last takes the remainder."""
    numbered = durable(global_numbers(rows, order, "__n"))
    step = max(1, numbered.count() // slices)
    return numbered.withColumn(out, F.least(F.floor(F.col("__n") / step), F.lit(slices - 1)).cast("int")).drop("__n")


def drop_repeats(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Rows without those that equal the row before in all ``fields``."""
    before = F.lag(F.struct(*fields)).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*order)).isNull()
    return rows.withColumn("__s", ~first & F.struct(*fields).eqNullSafe(before)).filter("not __s").drop("__s")


def islands(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str = "island") -> DataFrame:
    """Numbers the runs of equal ``fields`` within each key, from 0."""
    by = Window.partitionBy(*keys).orderBy(*order)
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.lag(f).over(by)) for f in fields])
    starts = F.when(F.lag(F.lit(1)).over(by).isNull(), 0).otherwise((~same).cast("int"))
    return rows.withColumn("__i", starts).withColumn(out, F.sum("__i").over(by)).drop("__i")


def island_collapse(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], prefer: Column, keep: list[str]) -> DataFrame:
    """One row an island: the first preferred row's ``keep`` columns, else the first row's, and its size."""
    marked = islands(rows, keys, order, fields)
    rank = F.struct(F.when(prefer, 0).otherwise(1).alias("p"), *order)
    return marked.groupBy(*keys, "island").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.min_by(c, rank).alias(c) for c in keep]
    )


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` at or before each row of its key."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, True).over(by))


def boundary_relabel(rows: DataFrame, queues: DataFrame, key: str, order: list[str], hit: Column, out: str = "override") -> DataFrame:
    """The queue head after as many hits as there were up to each row; null before the first or past the end.

    ``queues`` has (key, labels): the labels that boundaries of that key hand out in turn.
    """
    hits = F.sum(F.when(hit, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__h", hits).join(queues, key, "left")
    return joined.withColumn(out, F.when(F.col("__h") > 0, F.get("labels", F.col("__h") - 1))).drop("__h", "labels")


def label_numbers(rows: DataFrame, tick: str, order: list[str], out: str = "label") -> DataFrame:
    """Labels in arrival order: by tick, then source and sequence."""
    return global_numbers(rows, [tick, *order], out)


def first_of_text(rows: DataFrame, text: str, seq: str, start: int) -> DataFrame:
    """(text, seq): the first row of every text as it reads from character ``start`` (from 1) on; null texts drop out.

    An aggregate, so a text that is there millions of times is combined before it is moved.
    """
    tail = F.substring(text, start, 2**31 - 1)
    return rows.filter(F.col(text).isNotNull()).groupBy(tail.alias(text)).agg(F.min(seq).alias(seq))

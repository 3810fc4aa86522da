"""A shuffle of narrow rows as compressed columns, a fraction of the bytes of rows.

A task sorts the rows that it holds by where they go and sends those of one partition as one row: integers as
planes of their bytes (of the differences to the row before, where that is smaller), texts as lengths and bytes, each
compressed on its own. What arrives is taken apart and sorted by Spark, so no partition has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of rows that a task packs at once.
_HELD = 1 << 26
_LEVEL = 3


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _begins(lengths: np.ndarray) -> np.ndarray:
    """Where the lists that hold something begin."""
    lengths = lengths[lengths > 0].astype(np.int64)
    return np.cumsum(lengths) - lengths


class _Writer:
    """The pieces of a pack: for each the bytes that are kept, the bytes that it has and how it is written."""

    def __init__(self, rows: int) -> None:
        self.codec, self.sizes, self.parts = pa.Codec("zstd", compression_level=_LEVEL), [rows], []

    def piece(self, *forms: bytes) -> None:
        """The smallest of the forms, of one length."""
        size = len(forms[0])
        short = [self.codec.compress(f, asbytes=True) if size else b"" for f in forms]
        k = min(range(len(forms)), key=lambda i: len(short[i]))
        kept = short[k] if len(short[k]) < size else forms[k]
        self.sizes += [len(kept), size, k]
        self.parts.append(kept)

    def integers(self, values: np.ndarray) -> None:
        values = values.astype(np.int64)
        self.piece(_planes(values), _planes(np.diff(values, prepend=np.int64(0))))

    def column(self, c: pa.Array) -> None:
        self.piece(np.packbits(c.is_null().to_numpy(zero_copy_only=False)).tobytes() if c.null_count else b"")
        if pa.types.is_integer(c.type):
            self.integers(c.fill_null(0).to_numpy())
        elif pa.types.is_list(c.type):
            self.integers(pc.fill_null(pc.list_value_length(c), 0).to_numpy())
            flat = c.flatten()
            plain = pa.types.is_integer(flat.type) and not flat.null_count
            self.integers(np.array([len(flat), plain]))
            if plain:
                begins = _begins(pc.fill_null(pc.list_value_length(c), 0).to_numpy())
                values = flat.to_numpy().astype(np.int64)
                steps = np.diff(values, prepend=np.int64(0))
                self.integers(values[begins])
                self.integers(np.delete(steps, begins))
            else:
                self.column(flat)
        elif pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            whole = pa.concat_arrays([c.cast(pa.binary()).fill_null(b"")])
            ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
            self.integers(np.diff(ends))
            self.piece(whole.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if whole.buffers()[2] else b"")
        else:
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("c", c.type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([c], ["c"]))
            self.piece(sink.getvalue().to_pybytes())

    def done(self) -> bytes:
        return b"".join([np.array([len(self.sizes), *self.sizes], "<u4").tobytes(), *self.parts])


class _Reader:
    def __init__(self, pack: bytes) -> None:
        self.codec, self.pack = pa.Codec("zstd"), pack
        n = int(np.frombuffer(pack, "<u4", 1)[0])
        self.rows, *sizes = np.frombuffer(pack, "<u4", n, 4).tolist()
        self.sizes, self.at = iter(zip(sizes[::3], sizes[1::3], sizes[2::3], strict=True)), 4 * (n + 1)

    def piece(self) -> tuple[bytes, int]:
        kept, size, form = next(self.sizes)
        got = self.pack[self.at : self.at + kept]
        self.at += kept
        return got if kept == size else self.codec.decompress(got, size, asbytes=True), form

    def integers(self) -> np.ndarray:
        got, form = self.piece()
        values = np.ascontiguousarray(np.frombuffer(got, np.uint8).reshape(8, -1).T).view("<i8").ravel()
        return np.cumsum(values, dtype=np.int64) if form else values

    def lists(self, lengths: np.ndarray, size: int) -> pa.Array:
        begins, steps = _begins(lengths), np.zeros(size, np.int64)
        first = self.integers()
        steps[np.setdiff1d(np.arange(size), begins, True)] = self.integers()
        run, lengths = np.cumsum(steps), lengths[lengths > 0]
        return pa.array(run + np.repeat(first - run[begins], lengths))

    def column(self, kind: pa.DataType, n: int) -> pa.Array:
        bits, _ = self.piece()
        null = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else None
        if pa.types.is_integer(kind):
            return pa.array(self.integers(), mask=null).cast(kind)
        if pa.types.is_list(kind):
            ends = np.concatenate([[0], np.cumsum(self.integers())]).astype(np.int32)
            size, plain = self.integers().tolist()
            flat = self.lists(np.diff(ends), size).cast(kind.value_type) if plain else self.column(kind.value_type, size)
            return pa.ListArray.from_arrays(pa.array(ends), flat, type=kind, mask=None if null is None else pa.array(null))
        if pa.types.is_string(kind) or pa.types.is_binary(kind):
            ends = np.concatenate([[0], np.cumsum(self.integers())]).astype(np.int32)
            known = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
            return pa.Array.from_buffers(kind, n, [known, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.piece()[0])])
        return pa.ipc.open_stream(self.piece()[0]).read_all().column(0).combine_chunks()


def pack(rows: pa.RecordBatch) -> bytes:
    writer = _Writer(len(rows))
    for c in rows.columns:
        writer.column(c)
    return writer.done()


def unpack(packed: bytes, schema: pa.Schema) -> pa.RecordBatch:
    reader = _Reader(packed)
    return pa.RecordBatch.from_arrays([reader.column(f.type, reader.rows) for f in schema], schema=schema)


def send(batches: Iterator[pa.RecordBatch], schema: pa.Schema, key: str, near: list[str], parts: int) -> Iterator[pa.RecordBatch]:
    """(to, pack) of the rows: those of equal integers ``key`` go to one of the parts; a pack holds its rows by ``near``.

    Columns of the schema that the rows lack are null.
    """

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.append_column("__to", pa.array(np.mod(table[key].to_numpy().astype(np.int64), parts).astype(np.int32)))
        table = table.take(pc.sort_indices(table, [("__to", "ascending"), *((c, "ascending") for c in near)])).combine_chunks()
        to = table["__to"].to_numpy()
        columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(len(to), f.type) for f in schema]
        sent = pa.Table.from_arrays(columns, schema=schema)
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        made = [pack(sent.slice(i, j - i).combine_chunks().to_batches()[0]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]]), pa.array(made, pa.binary())], ["to", "pack"])

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size > _HELD:
            yield packs(held)
            held, size = [], 0
    if held:
        yield packs(held)


def shuffled(sides: list[tuple[DataFrame, Callable | None]], kind: str, key: str, order: list[str], near: list[str]) -> DataFrame:
    """The rows of all sides, of the schema ``kind``: those of equal ``key`` in one partition, sorted by ``order`` within.

    A side is a table, and what makes batches of rows of its batches, or None where they are the rows. There are as
    many partitions as ``spark.sql.shuffle.partitions`` says: what is packed tells too little of its size to join some.
    """
    spark = sides[0][0].sparkSession
    parts, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.createDataFrame([], kind).schema
    schema = to_arrow_schema(rows)

    def sender(made: Callable | None) -> Callable:
        return lambda batches: send(made(batches) if made else batches, schema, key, near, parts)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch["pack"]:
                yield unpack(packed.as_py(), schema)

    sent = reduce(DataFrame.union, [side.mapInArrow(sender(made), "to int, pack binary") for side, made in sides])
    return sent.repartitionById(parts, F.col("to")).mapInArrow(take, rows).sortWithinPartitions(*order)

"""Exact byte-level BPE of whole texts by backtracking, and its inverse by an offset table.

Method: an Aho-Corasick automaton over the reversed vocabulary gives, in one pass over a piece, the
longest token that begins at every byte. A greedy walk over these matches is corrected by a table
of compatible pairs: two neighbouring tokens can stand side by side in a BPE result exactly if no
merge would have crossed their border. Where a token does not fit, its next shorter prefix token is
tried, and where none fits the last token is taken back; a byte position is left at most once, so
the time is linear in the piece. Pieces come from the tokenizer's split pattern; results of short
pieces are remembered in a bounded table per worker, which changes speed only.

Defined results: null and empty texts give an empty list; text that looks like a special token is
ordinary text; texts of any length are encoded whole; null ids of documents are passed through; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies on every node; a parameter of all functions here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split pattern of the byte-level BPE (fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for ASCII texts, whose classes the faster built-in module can express.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Pieces remembered by a worker, and the longest piece that is remembered.
MEMO_PIECES, MEMO_CHARS = 200_000, 40
#: Documents whose ids are handed back together, which bounds a worker's memory.
HANDED_BACK = 500


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file: printable bytes are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import ahocorasick

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        ids = {bytes(alphabet[c] for c in name): i for name, i in model["vocab"].items() if all(c in alphabet for c in name)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.tokens: dict[bytes, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for byte in range(256):
            self.tokens[bytes([byte])] = ids[bytes([byte])]
            self.rank[ids[bytes([byte])]] = -256 + byte
        for rank, pair in enumerate(merges):
            left, right = (bytes(alphabet[c] for c in half) for half in pair)
            a, b, c = ids[left], ids[right], ids[left + right]
            if c not in self.rank:
                self.tokens[left + right], self.parts[c], self.rank[c], self.whole[a, b] = c, (a, b), rank, c
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self.length = {i: len(t) for t, i in self.tokens.items()}
        self.shorter = {i: self._prefix(t) for t, i in self.tokens.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        top = max(self.bytes_of) + 1
        self.offsets = np.zeros(top + 1, np.int64)
        self.offsets[1:] = np.cumsum([self.length.get(i, 0) for i in range(top)])
        self.blob = b"".join(self.bytes_of.get(i, b"") for i in range(top))
        self.split_any, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.memo = _Memo(self)

    def findall(self, text: str) -> list[str]:
        """The pieces of a text; together they are the text."""
        return self.split_ascii(text) if text.isascii() else self.split_any(text)

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        for end in range(len(token) - 1, 0, -1):
            if (found := self.tokens.get(token[:end])) is not None:
                return found
        return None

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stand side by side in the BPE of their joined bytes; an entry of the pair table."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo merges from the latest on, on either side of the border. A merge across the border
        # that is possible and earlier than what was undone last would have been made.
        rank, parts = self.rank, self.parts
        undone = 1 << 60
        while True:
            across = self.whole.get((a, b))
            if across is not None and rank[across] < undone:
                return False
            if rank[a] > rank[b]:
                if a not in parts:
                    return True
                undone, a = rank[a], parts[a][1]
            else:
                if b not in parts:
                    return True
                undone, b = rank[b] + 1, parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The BPE ids of one piece of the split pattern."""
        found = self.tokens.get(piece)
        if found is not None:
            return [found]
        n, length, shorter = len(piece), self.length, self.shorter
        longest: list[int] = [0] * n
        best = [0] * n
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            start = n - 1 - end
            if length[token] > best[start]:
                best[start], longest[start] = length[token], token
        out: list[int] = []
        dead = bytearray(n + 1)
        at = 0
        token: int | None = longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None and (
                dead[at + length[token]] or (last is not None and not self.compatible(last, token))
            ):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.findall(text)))) if text else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        offsets, blob = self.offsets, self.blob
        return b"".join(blob[offsets[i] : offsets[i + 1]] for i in ids)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Memo(dict):
    """Piece to ids; holds a bounded number of short pieces."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encode_piece = encoder.encode_piece

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode_piece(piece.encode("utf-8")))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary, made once per process."""
    return Encoder(vocabulary)


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for whole in batches:
            for low in range(0, whole.num_rows, HANDED_BACK):
                batch = whole.slice(low, HANDED_BACK)
                offsets, flat = np.zeros(batch.num_rows + 1, np.int32), []
                for k, text in enumerate(batch.column(1)):
                    ids = encode(text.as_py())
                    flat.append(np.array(ids, np.int32))
                    offsets[k + 1] = offsets[k] + len(ids)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=kind)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(rows: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of ids of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        findall, memo = coder.findall, coder.memo
        for batch in batches:
            sizes = [
                sum(map(len, map(memo.__getitem__, findall(text.as_py())))) if text.is_valid else 0
                for text in batch.column(len(keep))
            ]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, F.col(text)).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary).decode
        for batch in batches:
            texts = [decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=kind)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")

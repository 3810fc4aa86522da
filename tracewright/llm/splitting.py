"""Texts above a token limit cut at natural boundaries into pieces that overlap.

Method: agglomerative merging. A text is first broken into atoms at its own breaks (paragraphs and
changes of quoting, lines, sentence ends); an atom too large for a piece is broken on at white
space, then between pieces of the split pattern, then between tokens that end a character.
Neighbouring atoms lie in a heap by the strength of the boundary between them, the weakest first and
of equal ones the smallest pair; a pair is merged while both and the overlap fit into the limit.

A piece is a slice of the whole text's ids (``slice_tokens``), of which ``shared_tokens`` are its
neighbour's; ``n_tokens`` is the size of its text encoded on its own, which can differ where an end
lies within a word. Both are within the limit. Neighbours share exactly ``overlap_tokens`` ids where
that begins a character, so of natural boundaries those where it does are kept before others; else
up to three ids more. A piece whose own encoding is too large is cut again, it alone; only one that
has no boundary left shares fewer ids.

Defined results: texts within the limit (null and empty ones too) give no pieces; specs with null or
non-positive limit, or an overlap of the limit or more, are left out; negative and null overlaps
count as 0; an empty table gives no rows. The pieces of a text cover it whole. A limit below the
tokens of one character of a text (there are four at most) fails with the document's id.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewright.llm.bpe import VOCABULARY, Encoder, encoder

MAX_SPECS = 1000
TOKEN, GLYPH, WORD, SENTENCE, LINE, PARAGRAPH = range(6)
#: Ends of sentences and lines; a break lies at the end of a match.
_BREAKS = regex.compile(r"""[.!?…。！？]["')\]»”’]*(?=\s)|[。！？]|(?:\r\n?|\n| | )(?:[^\S\r\n]*(?:\r\n?|\n| | ))*""")
_LINES = regex.compile(r"\r\n?|\n| | ")
#: Borders of short parts are remembered by each worker, up to this number of them; this changes speed only.
MAX_BORDERS = 200_000
_BORDERS: dict[str, list[int | None]] = {}
_SCHEMA = (
    "spec_id string, doc_id bigint, piece int, start_char int, end_char int, n_tokens int, slice_tokens int, shared_tokens int, text string"
)
_ARROW = pa.schema(
    [
        ("spec_id", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start_char", pa.int32()),
        ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("slice_tokens", pa.int32()), ("shared_tokens", pa.int32()), ("text", pa.string()),
    ]
)


class Splitter:
    """Breaks, token offsets and cuts of one text."""

    def __init__(self, coder: Encoder, text: str) -> None:
        self.coder, self.text = coder, text
        self.parts = coder.findall(text)
        self.ids = list(map(coder.memo.__getitem__, self.parts))
        self.chars = [0, *accumulate(map(len, self.parts))]
        self.tokens = [0, *accumulate(map(len, self.ids))]
        self._borders: dict[int, list[int | None]] = {}
        self.total = self.tokens[-1]
        self._breaks: list[tuple[int, int]] | None = None
        self._marks: list[tuple[int, int]] | None = None
        self._cut: set[int] | None = None

    def breaks(self) -> list[tuple[int, int]]:
        """(index of the part that follows, strength) of every break of the text itself, in order."""
        if self._breaks is None:
            found: dict[int, int] = {}
            text, chars = self.text, self.chars
            for match in _BREAKS.finditer(text):
                end = match.end()
                strength = SENTENCE
                first = text[match.start()]
                if first in "\r\n  ":
                    lines = _LINES.findall(match.group())
                    begun = text.rfind("\n", 0, match.start()) + 1
                    quote_turns = text.startswith(">", begun) != text.startswith(">", end)
                    apart = text.startswith(("-- \n", "```"), end)
                    strength = PARAGRAPH if len(lines) > 1 or quote_turns or apart else LINE
                k = bisect_left(chars, end)
                if 0 < k < len(self.parts) and found.get(k, 0) < strength:
                    found[k] = strength
            self._breaks = sorted(found.items())
        return self._breaks

    def char_at(self, token: int) -> int | None:
        """The character offset at which a token begins, None inside a character."""
        k = bisect_right(self.tokens, token) - 1
        if self.tokens[k] == token:
            return self.chars[k]
        inside = self._border(k)[token - self.tokens[k]]
        return None if inside is None else self.chars[k] + inside

    def _border(self, k: int) -> list[int | None]:
        """For every token of a part, the character of the part at which it begins, None inside a character."""
        part = self.parts[k]
        known = _BORDERS.get(part) or self._borders.get(k)
        if known is None:
            # Offsets of the bytes that begin a character, and of those that tokens begin at.
            offset, at = {}, 0
            for n, char in enumerate(part):
                offset[at] = n
                at += 1 if char < "\x80" else 2 if char < "\u0800" else 3 if char < "\U00010000" else 4
            starts = accumulate(map(self.coder.length.__getitem__, self.ids[k]), initial=0)
            known = list(map(offset.get, starts))
            if len(part) <= 64 and len(_BORDERS) < MAX_BORDERS:
                _BORDERS[part] = known
            else:
                self._borders[k] = known
        return known

    def _inside(self, k: int, room: int) -> list[tuple[int, int]]:
        """(token, strength) of cuts inside a part that is larger than a piece may be."""
        base, step, last, out = self.tokens[k], max(1, room // 8), 0, []
        border = self._border(k)
        for n in range(1, len(self.ids[k])):
            if n - last >= step and border[n] is not None:
                out.append((base + n, TOKEN))
                last = n
        return out

    def atoms(self, room: int) -> list[tuple[int, int]]:
        """(first token, strength of the boundary before) of every atom."""
        tokens, parts = self.tokens, self.parts
        if self._marks is None:
            self._marks = [(0, PARAGRAPH), *self.breaks()]
            self._own = [(tokens[k], strength) for k, strength in self._marks]
            edges = [*(a for a, _ in self._own), self.total]
            self._largest = max(b - a for a, b in zip(edges, edges[1:]))
        if self._largest <= room:
            return self._own
        marks = self._marks
        out: list[tuple[int, int]] = []
        for (first, strength), (end, _) in zip(marks, [*marks[1:], (len(parts), 0)], strict=True):
            out.append((tokens[first], strength))
            if tokens[end] - tokens[first] <= room:
                continue
            # Too large: on at white space, and where that leaves too much, between parts and tokens.
            words = [k for k in range(first + 1, end) if parts[k][0].isspace() or parts[k - 1][-1].isspace()]
            for low, high in zip([first, *words], [*words, end], strict=True):
                if low > first:
                    out.append((tokens[low], WORD))
                if tokens[high] - tokens[low] > room:
                    for k in range(low, high):
                        if k > low:
                            out.append((tokens[k], GLYPH))
                        if tokens[k + 1] - tokens[k] > room:
                            out += self._inside(k, room)
        return out

    def _whole(self, token: int) -> bool:
        """Whether a token begins a character."""
        if self._cut is None:
            cut = self._cut = set()
            if not self.text.isascii():
                for k, part in enumerate(self.parts):
                    if len(self.ids[k]) > 1 and not part.isascii() and None in (border := self._border(k)):
                        cut.update(self.tokens[k] + n for n, at in enumerate(border) if at is None)
        return token not in self._cut

    def _ranked(self, atoms: list[tuple[int, int]], overlap: int) -> list[tuple[int, int]]:
        """Atoms with the rank of the boundary before: natural ones above others, in each those where the exact overlap begins a character."""
        return [
            (a, strength + 3 * (strength >= SENTENCE) + 3 * (not overlap or self._whole(max(a - overlap, 0))))
            for a, strength in atoms
        ]

    def merged(self, held: list[tuple[int, int]], last: int, first_room: int, room: int) -> list[tuple[int, int]]:
        """(first, end) tokens of the pieces without their overlaps, from ranked atoms that end at ``last``."""
        # Merging never makes a boundary weaker, so ranks are done one after the other, and what
        # lies between stronger boundaries is merged on its own.
        for level in sorted({rank for _, rank in held[1:]}):
            out: list[tuple[int, int]] = []
            n, low = len(held), 0
            while low < n:
                high = low + 1
                while high < n and held[high][1] <= level:
                    high += 1
                end = held[high][0] if high < n else last
                if high - low == 1 or end - held[low][0] <= room:
                    out.append(held[low])  # all of it fits, so every merge within would be made
                else:
                    out += _merge(held[low:high], end, room, first_room if low == 0 else room)
                low = high
            held = out
        first = [a for a, _ in held]
        return list(zip(first, [*first[1:], last], strict=True))

    def own_size(self, first: int, end: int, at: int, to: int) -> int:
        """Tokens of the slice when encoded on its own.

        Parts are found from left to right with one character ahead, so a text that begins within a part is
        split as the whole from the next common border on, and at its end only a run of white space that
        was split before what follows can differ.
        """
        tokens, parts = self.tokens, self.parts
        low, high = bisect_right(tokens, first) - 1, bisect_left(tokens, end)
        size = 0
        if tokens[low] != first:
            begun = self.coder.findall(self.text[at : min(self.chars[min(low + 3, len(parts))], to)])[0]
            if at + len(begun) != self.chars[low + 1]:
                return len(self.coder.encode(self.text[at:to]))
            size = len(self.coder.memo[begun])
            low += 1
        if low >= high:
            return size
        whole = tokens[high] == end
        if whole and not (parts[high - 1].isspace() and high - 2 >= low and parts[high - 2].isspace()):
            return size + end - tokens[low]
        near = max(low, high - 2)
        while near > low and parts[near].isspace() and parts[near - 1].isspace():
            near -= 1
        return size + tokens[near] - tokens[low] + len(self.coder.encode(self.text[self.chars[near] : to]))

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """(start char, end char, own tokens, tokens of the slice, shared tokens) of every piece."""
        room = limit - overlap
        atoms = self._ranked(self.atoms(room), overlap)
        todo = self.merged(atoms, self.total, limit, room)[::-1]
        starts = [a for a, _ in atoms]
        out: list[tuple[int, int, int, int, int]] = []
        while todo:
            first, end = todo.pop()
            inner = atoms[bisect_right(starts, first) : bisect_left(starts, end)]
            begun = self._begin(first, end, limit, overlap if out else 0, not inner)
            if begun is not None:
                begin, at, own = begun
                out.append((at, self.char_at(end), own, end - begin, first - begin))
                continue
            # Encoded on its own it would be too large: only this piece is cut again, where it is strongest.
            inner = inner or self._ranked(self._finer(first, end), overlap)
            if not inner:
                raise ValueError(f"one character takes more than {limit} tokens")
            todo += self.merged([(first, 99), *inner], end, end - first - 1, end - first - 1)[::-1]
        return out

    def _begin(self, first: int, end: int, limit: int, overlap: int, last_way: bool) -> tuple[int, int, int] | None:
        """(token, char, own tokens) at which a piece begins so that it fits.

        The exact overlap, or where that would split a character up to three ids more; ``last_way``
        says that the piece has no boundary left to cut it at, so that fewer ids are tried too.
        """
        to = self.char_at(end)
        exact = max(first - overlap, 0)
        tries = [exact] if self._whole(exact) else range(exact - 1, max(exact - 4, -1), -1)
        if last_way and overlap:
            tries = [*tries, *range(exact + 1, first + 1)]
        for begin in tries:
            at = self.char_at(begin)
            if at is not None and end - begin <= limit and (own := self.own_size(begin, end, at, to)) <= limit:
                return begin, at, own
        return None

    def _finer(self, first: int, end: int) -> list[tuple[int, int]]:
        """Cuts inside one atom: at white space, else between parts, else between tokens that begin a character."""
        parts = range(bisect_right(self.tokens, first), bisect_left(self.tokens, end))
        words = [(self.tokens[k], WORD) for k in parts if self.parts[k][0].isspace() or self.parts[k - 1][-1].isspace()]
        return words or [(self.tokens[k], GLYPH) for k in parts] or [(t, TOKEN) for t in range(first + 1, end) if self._whole(t)]


def _merge(atoms: list[tuple[int, int]], total: int, room: int, first_room: int) -> list[tuple[int, int]]:
    """Atoms merged pair by pair, weakest boundary and then smallest pair first, while pairs fit."""
    n = len(atoms)
    start = [a for a, _ in atoms]
    end = [*start[1:], total]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # An entry names both atoms and their size at the time; it is stale once either has grown.
    # Pairs that do not fit are never entered: sizes only grow, so such a boundary stays a cut.
    heap = [
        (atoms[k][1], end[k] - start[k - 1], k, k - 1)
        for k in range(1, n)
        if end[k] - start[k - 1] <= (room if k > 1 else first_room)
    ]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, size, right, left = heapq.heappop(heap)
        if not alive[right] or before[right] != left or end[right] - start[left] != size:
            continue
        alive[right] = False
        end[left] = end[right]
        new = after[right]
        after[left] = new
        if new < n:
            before[new] = left
            if (size := end[new] - start[left]) <= (room if left else first_room):
                heapq.heappush(heap, (atoms[new][1], size, new, left))
        if left > 0 and (size := end[left] - start[before[left]]) <= (room if before[left] else first_room):
            heapq.heappush(heap, (atoms[left][1], size, left, before[left]))
    return [atoms[k] for k in range(n) if alive[k]]


def split_documents(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every document that is larger than a spec's limit, for every spec."""
    listed = specs.select("spec_id", "max_tokens", "overlap_tokens").limit(MAX_SPECS + 1).collect()
    if len(listed) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    wanted = [
        (name, limit, max(overlap or 0, 0)) for name, limit, overlap in listed if (limit or 0) > max(overlap or 0, 0)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if not text:
                    continue
                splitter = Splitter(coder, text)
                for name, limit, overlap in wanted:
                    if splitter.total <= limit:
                        continue
                    try:
                        cut = splitter.pieces(limit, overlap)
                    except ValueError as problem:
                        raise ValueError(f"doc_id {doc}, spec {name}: {problem}") from problem
                    for k, (at, to, own, size, shared) in enumerate(cut):
                        rows.append((name, doc, k, at, to, own, size, shared, text[at:to]))
                        held += to - at
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

import os
import random

import pytest

from tracewright.llm import bpe, splitting

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
SPECS = "spec_id string, max_tokens int, overlap_tokens int"


def random_text(rng):
    out = []
    for _ in range(rng.randint(1, 30)):
        out.append(rng.choice(["One sentence here. ", "Ünïcode wörter und mehr! ", "漢字かな交じり文。", "\n", "\n\n", "> quoted line\n", "x" * 300, "🙂🙂🙂", "   ", "a-b/c:d;e,f ", "-- \nsig\n"]) * rng.randint(1, 6))
    return "".join(out)


def check(text, limit, overlap):
    coder = bpe.encoder()
    splitter = splitting.Splitter(coder, text)
    ids = coder.encode(text)
    pieces = splitter.pieces(limit, overlap)
    done, last = 0, None
    for at, to, own, size, shared in pieces:
        assert 0 < size <= limit and 0 <= shared < limit
        part = text[at:to]
        assert len(coder.encode(part)) == own <= limit
        first = done - shared
        assert coder.decode(ids[first : first + size]) == part
        if last is not None and overlap:
            assert shared <= overlap + 3
        done, last = first + size, to
    assert done == len(ids) and last == len(text)
    return pieces


def test_random_texts_are_covered_within_limits():
    rng = random.Random(8)
    for _ in range(150):
        text = random_text(rng)
        for limit, overlap in ((16, 4), (64, 0), (64, 16), (200, 20)):
            if len(bpe.encoder().encode(text)) > limit:
                check(text, limit, overlap)


def test_cuts_lie_where_the_text_breaks_off():
    paragraph = "Some words in a sentence. And one more of them here."
    text = "\n\n".join([paragraph] * 12)
    pieces = check(text, 40, 0)
    assert all(text[to - 2 : to] == "\n\n" for _, to, *_ in pieces[:-1])
    lines = "\n".join(["a line of seven words or so"] * 20)
    assert all(lines[to - 1] == "\n" for _, to, *_ in check(lines, 30, 5)[:-1])
    assert all(s == 5 for *_, s in check(lines, 30, 5)[1:])


def test_unbroken_text():
    check("x" * 20_000, 128, 16)
    check("漢" * 4000, 128, 16)
    check("q" * 1000, 2, 1)
    check("🙂" * 50, 4, 1)
    with pytest.raises(ValueError):
        check("𓀀" * 50, 1, 0)


def test_exact_overlaps_come_first():
    text = "".join(f"これは{k}番目の文です。とても短い。" for k in range(200))
    shared = [s for *_, s in check(text, 128, 16)[1:]]
    assert sum(s == 16 for s in shared) >= 0.9 * len(shared)


def test_documents(spark):
    text = "A few words in a row. " * 40
    rows = [(1, text), (2, "short"), (3, None), (4, ""), (5, text)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as piece", "2 as spec_id")
    specs = spark.createDataFrame([("a", 50, 5), ("b", 100, 0), ("c", None, 0), ("d", 5, 5), ("e", 60, None)], SPECS)
    got = splitting.split_documents(documents, specs).collect()
    assert {r.doc_id for r in got} == {1, 5} and {r.spec_id for r in got} == {"a", "b", "e"}
    one = [r for r in got if (r.spec_id, r.doc_id) == ("b", 1)]
    assert "".join(r.text for r in one) == text and [r.piece for r in one] == list(range(len(one)))
    assert splitting.split_documents(documents.limit(0), specs).count() == 0
    assert splitting.split_documents(documents, specs.limit(0)).count() == 0

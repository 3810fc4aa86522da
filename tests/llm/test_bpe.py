import os
import random

import pytest
from tokenizers import Tokenizer

from tracewright.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
TEXTS = [
    None, "", " ", "hello world", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 2000 + "x", "\n\n\t x", "漢字" * 500, "🙂é́‍",
    "don't we'LL 123 ²½", "\r\n  x y", "abcde" * 3000, "�\x00",
]


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(bpe.VOCABULARY)
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids if text else []


def test_same_ids_as_the_public_library(reference):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("abcdefghij etaoin\n  .,é漢🙂0123'") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    coder = bpe.encoder()
    for text in texts:
        ids = coder.encode(text)
        assert ids == reference(text)
        assert coder.decode(ids) == (text or "")


def test_pair_table_agrees_with_encoding(reference):
    coder, rng = bpe.encoder(), random.Random(7)
    ids = list(coder.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        joined = coder.bytes_of[a] + coder.bytes_of[b]
        assert coder.compatible(a, b) == (coder.encode_piece(joined) == [a, b])


def test_documents(spark, reference):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (3, "hello world")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    encoded = bpe.encode_documents(documents)
    got = [(r.doc_id, r.ids) for r in encoded.collect()]
    assert got == [(k, reference(t)) for k, t in rows]
    assert [r.text for r in bpe.decode_documents(encoded).collect()] == [t or "" for _, t in rows]
    assert [r.n_tokens for r in bpe.count_tokens(documents, ["doc_id"]).collect()] == [len(ids) for _, ids in got]
    assert bpe.encode_documents(documents.limit(0)).count() == 0


def test_ascii_pattern_splits_alike():
    coder, rng = bpe.encoder(), random.Random(9)
    signs = "".join(map(chr, range(128))) + " \n\t" * 10
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        assert coder.split_ascii(text) == coder.split_any(text) and "".join(coder.findall(text)) == text

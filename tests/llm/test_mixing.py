import os

import numpy as np
import pytest

from tracewright.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
DOCS = "doc_id bigint, text string, source string"
TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def test_splitting_tree_is_exact_and_balanced():
    tree = mixing.splitting_tree([100, 7, 0, 1], 6)
    assert tree.sum(axis=0).tolist() == [100, 7, 0, 1]
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3 and (tree >= 0).all()
    assert (mixing.splitting_tree([0], 1) == np.zeros((1, 1))).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, "word " * (k % 40 + 1), "big") for k in range(900)] + [(1000 + k, "word " * 20, "small") for k in range(40)]
    rows += [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (2003, "word", "tiny")]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as shard", "2 as block")


def test_shares_repeats_and_shards(spark, corpus):
    asked = [("a", "big", 0.5, 1), ("a", "small", 0.5, 3), ("b", "big", 0.9, 1), ("b", "none", 0.1, 5), ("c", "big", None, 1), ("c", "tiny", 0.5, 0), ("d", None, 1.0, 1)]
    targets = spark.createDataFrame(asked, TARGETS)
    mixed = mixing.mix_sources(corpus, targets, block_tokens=500, shard_tokens=1500).cache()
    report = {(r.mix_id, r.source): r for r in mixing.shares_reached(mixed, targets).collect()}
    assert abs(report["a", "big"].share - 0.5) < 0.02 and report["a", "small"].most_copies == 3
    assert report["a", "small"].tokens == 3 * mixed.filter("mix_id = 'a' and source = 'small' and copy = 1").groupBy().sum("n_tokens").first()[0]
    assert report["b", "big"].share == 1 and report["b", "none"].share == 0 and report["c", "tiny"].tokens == 0
    assert mixed.groupBy("mix_id", "doc_id", "copy").count().filter("count > 1").count() == 0
    assert mixed.filter("n_tokens = 0").count() == 0
    shards = {(r.mix_id, r.shard): r for r in mixed.groupBy("mix_id", "shard").agg({"n_tokens": "sum", "position": "max", "doc_id": "count"}).collect()}
    assert len([k for k in shards if k[0] == "b"]) > 3
    assert all(r["max(position)"] == r["count(doc_id)"] for r in shards.values())
    again = mixing.mix_sources(corpus, targets, block_tokens=500, shard_tokens=1500)
    assert again.exceptAll(mixed).count() == 0


def test_total_that_a_source_cannot_reach(spark, corpus):
    targets = spark.createDataFrame([("a", "big", 0.5, 1), ("a", "small", 0.5, 2)], TARGETS)
    mixed = mixing.mix_sources(corpus, targets, total_tokens=20_000, block_tokens=500)
    report = {r.source: r for r in mixing.shares_reached(mixed, targets).collect()}
    assert report["small"].most_copies == 2 and report["small"].share < 0.5 and abs(report["big"].tokens - 10_000) < 100


def test_empty(spark, corpus):
    targets = spark.createDataFrame([("a", "big", 1.0, 1)], TARGETS)
    assert mixing.mix_sources(corpus.limit(0), targets).count() == 0
    assert mixing.mix_sources(corpus, targets.limit(0)).count() == 0

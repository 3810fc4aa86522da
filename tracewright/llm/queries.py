"""Queries of the problems tagged llm (3, 5, 7, 8 and 9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, mixing, nearest_time, runs, splitting
from tracewright.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_time.found_pairs(*(table(spark, d, t) for t in ("netlogs", "apachelogs", "workers")))


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    return bpe.count_tokens(table(spark, d, "documents"), ["doc_id"])


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mixtargets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(p8_mix(spark, d), table(spark, d, "mixtargets"))


QUERIES: dict[str, Query] = {
    "p3_found": lambda s, d: runs.found_runs(table(s, d, "edges")),
    "p3_runs": lambda s, d: runs.collapse_runs(table(s, d, "edges")),
    "p5_found": p5_found,
    "p7_ids": lambda s, d: bpe.encode_documents(table(s, d, "documents")),
    "p7_lengths": p7_lengths,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_pieces": lambda s, d: splitting.split_documents(table(s, d, "documents"), table(s, d, "cutspecs")),
}
#: Pointer doubling, tries, BPE, sampling and splitting are held against brute force and round trips in tests.
SQL: dict[str, str] = {}

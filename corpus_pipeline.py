"""Corpus pipeline over `documents`: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. Nulls, repeated rows and empty tables are as the operators' modules say. The result of a
stage is to be written before the next stage is called.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from doclattice.llm import bpe, contamination, lines, quality, simhash
from doclattice.llm.common import drop_stored, scratch_paths, ship, stored, table

#: Scratch tables of the last stage that was called.
_left: list[str] = []


def _stage(function):
    """A stage begins when the one before is written; what that one had in the shared folder goes."""

    @functools.wraps(function)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stored(spark, _left)
        before = set(scratch_paths())
        out = function(spark, docs, sf_dir)
        _left[:] = [p for p in scratch_paths() if p not in before]
        return out

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or their group's fences go."""
    return quality.filtered(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred before are deleted from the texts; all documents stay."""
    return lines.deduplicated(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays. SimHash
    fingerprints find them on the popcount grid, and the sets of shingles decide."""
    return simhash.deduplicated(docs, simhash.NEAR)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an eight-word phrase of any benchmark item go."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with hashes of the ids and of their decoding."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encode", encode),
]

#: Fingerprints and merges can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_stored(spark, before)
        before = scratch_paths()[-1:]
    out = STAGES[-1][1](spark, docs, sf_dir)
    _left.clear()  # not written yet: its tables stay until the driver ends
    return out

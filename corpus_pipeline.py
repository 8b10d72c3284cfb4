"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage's result as Parquet into the folder that ``spark.checkpoint.dir`` names
and reads it back as the next stage's input.

Defined results: a stage given an empty table returns an empty one; NULL texts are empty texts (which the quality rules
reject); further columns are carried through by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablesteps.llm import bpe, exact_dedup, jaccard_dedup, mixing, quality_rules
from tablesteps.llm.common import Scratch, collected, documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[tuple[int, Scratch]]] = {}


def _tidy(number: int) -> Callable[[Stage], Stage]:
    """Removes what stages before this one over ``sf_dir`` staged, once ``docs`` is read from elsewhere.

    A stage's result is written before the next stage starts. Where it is not, and ``docs`` still reads an
    earlier stage's staged tables, everything stays. Calling one stage twice removes nothing of the first call.
    """

    def of(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            left = _left.setdefault(sf_dir, [])
            done = [s for k, s in left if k < number]
            if done and not any(s.name in file for file in docs.inputFiles() for s in done):
                for scratch in done:
                    scratch.clear()
                left[:] = [x for x in left if x[0] >= number]
            with collected() as made:
                out = stage(spark, docs, sf_dir)
            left.extend((number, s) for s in made)
            return out

        return run_stage

    return of


@_tidy(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@_tidy(1)
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


@_tidy(2)
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return jaccard_dedup.drop_near_duplicates(docs)


@_tidy(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per copy taken."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


@_tidy(4)
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and of what they decode to."""
    # executors still hold what the stages before needed, so blocks are smaller than the operator's own and fewer words are remembered
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern, block_bytes=2_000_000, remembered=250_000)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near-dedup", near), ("mixing", mixed), ("byte-level BPE", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs


#: Near-dedup, hash-ordered mixing and BPE have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None

"""The corpus pipeline: from documents to packed token sequences.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir), works on all rows of docs
and returns a DataFrame; run() writes each result as Parquet into the shared folder and reads it
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import drop_since, drop_table, read_table, release_memory, write_table, written
from quern.llm.exact_dedup import dedup_rows
from quern.llm.minhash import distinct_rows
from quern.llm.mixing import draw_rows, plan_mix
from quern.llm.packing import pack
from quern.llm.quality import fit_on, good_rows
from quern.llm.queries import tokenizer_path


def _lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after which and before which the driver gives back what native memory planning has left behind."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_memory(spark)
        out = stage(spark, docs, sf_dir)
        release_memory(spark)
        return out

    return run_stage


@_lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled documents of the input tables."""
    return good_rows(docs, fit_on(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


@_lean
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id."""
    return dedup_rows(docs)


@_lean
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return distinct_rows(docs)


@_lean
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, by shard, shuffled within it."""
    plan, _ = plan_mix(docs)
    return draw_rows(docs, plan).drop("_shard")


@_lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, each with its sequence and its place there."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("packing", packing)]

#: The classifier, the signatures and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents that went through all stages. Once a stage's result is written, what the stage left in the shared folder goes, and then the result before it; the last stage's tables stay, as the returned pieces read them."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = written()
        out = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(spark, mark, but=1)
        if before is not None:
            drop_table(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from documents: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage works on all that the one before kept, and is written as Parquet and read again in between.
"""

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepair.llm.common import CUTS, drop_cuts, ready, shared_folder, table
from tidepair.llm.decontaminate import drop_contaminated
from tidepair.llm.mixing import repeat_documents
from tidepair.llm.neardup import drop_near_duplicates
from tidepair.llm.quality import filter_documents
from tidepair.llm.tokens import read_tokens, write_tokens


_KEPT: list[str] = []


def stage(work: Callable) -> Callable:
    """A stage starts when the one before is written: what that one kept in the shared folder meanwhile goes first."""

    @functools.wraps(work)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        drop_cuts(spark, _KEPT)
        before = len(CUTS)
        out = work(spark, docs, sf_dir)
        _KEPT.extend(CUTS[before:])
        return out

    return step


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host is not rejected."""
    return filter_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (shingles of five words, similarity from 0.8 on)."""
    return drop_near_duplicates(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows repeat, or go."""
    return repeat_documents(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token table of the mix, read back: one row per repetition, in ascending order of doc_id."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    write_tokens(docs, folder)
    return read_tokens(spark, folder, ids=False)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_ids", token_ids)]

#: Near duplicates, decontamination and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    for name, step in STAGES[:-1]:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, benchmark passages are cut, personal
data gets surrogates, and sources are mixed to their targets.

Every stage works on all that the one before kept. A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontaminate, dedup, mixing, pii, toxicity
from tidegraph.llm.common import shared_folder, ship, shrink_executors, small_batches, table
from tidegraph.llm.queries import KEY, TOXIC, WINDOW
from tidegraph.sources.shared import release, tables_made, tables_since

MAX_COVERAGE = 0.5
_held: list[str] = []  # intermediate tables of the stage before


def stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the intermediate tables of the one before, whose result has been written and is this one's docs."""

    @wraps(make)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        release(spark, _held)
        shrink_executors(spark)
        mark = tables_made()
        out = make(spark, docs, sf_dir)
        _held[:] = tables_since(mark)
        return out

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go. Null and empty texts, and all of them where labels lack a class, score 0 and stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), TOXIC)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id. Texts without words are one group."""
    return dedup.drop_near_duplicates(docs)


@stage
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which over half the words are benchmark passages go; in others the passages are cut out, and n_chars follows. Null texts
    stay null, with a null n_chars; without benchmark items nothing is cut."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), WINDOW, max_coverage=MAX_COVERAGE)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


@stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; entities get surrogates, and n_chars follows. Null texts stay null."""
    return pii.with_surrogates(docs, KEY).withColumn("n_chars", F.length("text").cast("long"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, the words taken, and copies: how often each is in it."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # SQL can't express the stages; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, apply) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        apply(spark, docs, sf_dir).write.parquet(path)
        if i:
            release(spark, [f"{folder}/{i - 1}-{STAGES[i - 1][0]}"])  # the result of the stage before has been read
        docs = spark.read.parquet(path)
    return docs

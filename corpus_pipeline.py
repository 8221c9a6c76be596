"""The corpus pipeline: quality, near duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs.  All stages but the last return the
columns that they were given.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import ship
from aspectra.llm import jaccard, mixing, packing, resampling, secrets
from aspectra.llm.q_packing import tokenizer_path
from aspectra.llm.spark import materialize, table, unused


CACHE_WORDS = 100_000  # encoded words that a worker keeps, for it has seen other stages before


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good text draws; the others go."""
    return resampling.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with Jaccard 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; texts without one stay as they are."""
    found, spans, masked = unused(docs, "secrets", "spans", "masked")
    scanned = secrets.scan_secrets(docs, into=found)
    scanned = scanned.withColumn(spans, F.array_sort(F.concat(F.col(found)["base"], F.col(found)["added"])))
    hit = F.size(spans) > 0
    scanned = scanned.withColumn(masked, F.when(hit, secrets.redact(F.col("text"), F.col(spans))))
    changes = {"text": F.when(hit, F.col(masked)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return scanned.withColumns(changes).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their raked rates."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs, tokenizer_path(), words=CACHE_WORDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage, run once the package is with the session's workers."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship.ensure(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality", _shipped(quality)),
    ("near_duplicates", _shipped(near_duplicates)),
    ("secret_scan", _shipped(secret_scan)),
    ("mix_sources", _shipped(mix_sources)),
    ("pack", _shipped(pack)),
]
#: A trained classifier and an exact near-duplicate join over all texts are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

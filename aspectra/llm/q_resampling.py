"""op2: the documents that importance resampling towards good text draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import resampling
from .spark import table


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_importance_resampling": op2_importance_resampling}
ORACLE_SQL: dict[str, str] = {}

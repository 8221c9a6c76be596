"""op3: fingerprints of documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sketches as S
from .spark import table


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.against_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLE_SQL: dict[str, str] = {}

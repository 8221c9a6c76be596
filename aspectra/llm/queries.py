"""The contract queries opN_<name>: thin layers over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_jaccard, q_language, q_mixing, q_mtree, q_packing, q_resampling, q_secrets, q_sketches, q_suffixes, q_warc

_MODULES = (q_mixing, q_resampling, q_sketches, q_suffixes, q_warc, q_secrets, q_language, q_mtree, q_jaccard, q_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

"""op7: the language of every document, with a fold held out from training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language as L
from .spark import table


def op7_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, langs = L.train(docs.where(~L.held_out() & docs.doc_id.isNotNull()))
    found = L.predict(docs, net, langs)
    return found.select("doc_id", L.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_byte_gru": op7_byte_gru}
ORACLE_SQL: dict[str, str] = {}

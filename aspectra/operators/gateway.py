"""What a service in front of the tables offers: products, predictions, status, triggers, and their removal.

A product's reviews are a table partitioned by product; its summary and its
completion marker stand beside it.  Every function takes and returns DataFrames
or plain values, so any server can call it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import fields
from aspectra.functions import sentiment as S
from aspectra.operators import reviews as R
from aspectra.sources import files


def aspects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a) for k, a in enumerate(S.ASPECTS)], "place int, aspect string")


def _there(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table, or an empty one where nothing is written yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


REVIEWS = "review_id string, text string, sentiment string, product_id string"


def save_reviews(df: DataFrame, folder: str) -> None:
    """Reviews by product; a product that ``df`` has is replaced, the others stay."""
    df.select("review_id", "text", "sentiment", "product_id").write.partitionBy("product_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/reviews")


def product_reviews(spark: SparkSession, folder: str, product: str | None = None) -> DataFrame:
    df = _there(spark, f"{folder}/reviews", REVIEWS)
    return df if product is None else df.where(F.col("product_id") == product)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    return files.listing(spark, f"{folder}/reviews")


def prediction(spark: SparkSession, folder: str, product: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, scorecard) of a product, whatever code its payloads are in; rows without a payload count for nothing."""
    own = product_reviews(spark, folder, product)
    return own, scorecards(own)


def scorecards(df: DataFrame) -> DataFrame:
    """Scorecards of ``df(product_id, sentiment)`` with payloads as JSON."""
    return R.scorecard(df.select("product_id", S.parse_payload(F.col("sentiment")).alias("cells")), "cells", ["product_id"])


def save_summary(card: DataFrame, folder: str) -> None:
    """Summaries as JSON by product, then the markers that say they are whole."""
    card.write.partitionBy("product_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(f"{folder}/summary")
    card.select("product_id").distinct().withColumn("state", F.lit("completed")).write.partitionBy("product_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(f"{folder}/done")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return _there(spark, f"{folder}/summary", "aspect string, score double, review_count long, pct_pos double, pct_neg double, pct_neu double, has_mixed boolean, product_id string", "json")


def save_trigger(spark: SparkSession, folder: str, url: str, most: int = 50) -> str:
    """Append a request for a product's reviews; its id is that of the URL, or one made from it."""
    row = spark.createDataFrame([(url, most)], "product_url string, max_reviews int")
    made = F.concat(F.lit("product_"), F.substring(F.sha2("product_url", 256), 1, 14))
    row = row.select(F.coalesce(fields.item_id(F.col("product_url"), "api"), made).alias("product_id"), "*", F.current_timestamp().alias("triggered_at"))
    row.write.mode("append").json(f"{folder}/triggers")
    return row.first()["product_id"]


def statuses(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(product_id, status, review_count) of ``wanted(product_id)``: completed, processing or not_found."""
    have = product_reviews(spark, folder).groupBy("product_id").agg(F.count("*").alias("review_count"))
    done = _there(spark, f"{folder}/done", "state string, product_id string", "json").select("product_id").distinct().withColumn("done", F.lit(True))
    asked = _there(spark, f"{folder}/triggers", "product_id string", "json").select("product_id").distinct().withColumn("asked", F.lit(True))
    every = wanted.select("product_id").distinct().join(have, "product_id", "left").join(done, "product_id", "left").join(asked, "product_id", "left")
    state = F.when(F.col("review_count").isNotNull(), F.when(F.col("done"), "completed").otherwise("processing")).when(F.col("asked"), "processing").otherwise("not_found")
    return every.select("product_id", state.alias("status"), F.coalesce("review_count", F.lit(0)).alias("review_count"))


def clear(spark: SparkSession, folder: str) -> int:
    """Empty the reviews, summaries and markers; the number of products that went."""
    gone = product_reviews(spark, folder).select("product_id").distinct().count()
    spark.createDataFrame([], REVIEWS).write.mode("overwrite").parquet(f"{folder}/reviews")
    for name in ("summary", "done"):
        spark.createDataFrame([], "state string").write.mode("overwrite").json(f"{folder}/{name}")
    return gone

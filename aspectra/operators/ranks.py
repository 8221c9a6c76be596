"""Ranks over whole tables and large groups, without one task that sees them all.

Values fall in buckets whose edges are quantiles; a rank is the count of the
buckets before plus the rank within the bucket.  Edges, a fixed number, are all
that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Start counts that are broadcast at most; more are joined by key.
MOST_STARTS = 200_000
SAMPLE_A_BUCKET = 40


def width(df: DataFrame) -> int:
    """Buckets: a few for every task of a shuffle."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def edges(df: DataFrame, value: str, buckets: int) -> list:
    """Lower bounds of all buckets but the first: quantiles of numbers, else of a sample by hash, in the order of the type."""
    if df.schema[value].dataType.typeName() != "string":
        return sorted(set(df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.2 / buckets)))
    n, wanted = df.count(), buckets * SAMPLE_A_BUCKET
    part = df.select(value).where(F.col(value).isNotNull())
    part = part if n <= 2 * wanted else part.where(F.pmod(F.xxhash64(value), F.lit(n // wanted)) == 0)
    rows = [r[0] for r in part.distinct().orderBy(value).collect()]
    return [rows[k * len(rows) // buckets] for k in range(1, buckets)] if len(rows) > buckets else []


def bucket(value: Column, bounds: list) -> Column:
    """Number of the bounds that the value reaches, found by halving."""
    if not bounds:
        return F.lit(0)

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(bounds[middle]), pick(middle + 1, high)).otherwise(pick(low, middle))

    return pick(0, len(bounds))


def running(df: DataFrame, value: str, into: str, keys: tuple[str, ...] = (), order: tuple[str, ...] = (), weight: str | None = None, bounds: list | None = None) -> DataFrame:
    """``df`` with ``into``: the sum of ``weight`` (or the count) of the rows up to this one, by ``value``, then ``order``, within ``keys``."""
    bounds = edges(df, value, width(df)) if bounds is None else bounds
    own = df.withColumn("_bucket", bucket(F.col(value), bounds))
    one = F.col(weight) if weight else F.lit(1)
    sums = own.groupBy(*keys, "_bucket").agg(F.sum(one).alias("_sum"))
    upto = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row a bucket
    starts = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(upto.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.sum(one).over(Window.partitionBy(*keys, "_bucket").orderBy(value, *order).rowsBetween(Window.unboundedPreceding, 0))
    starts = F.broadcast(starts) if not keys or starts.count() <= MOST_STARTS else starts
    return own.withColumn("_inside", inside).join(starts, [*keys, "_bucket"]).withColumn(into, F.col("_start") + F.col("_inside")).drop("_bucket", "_start", "_inside")

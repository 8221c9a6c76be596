"""Scorecards, summaries, key figures, dedup, upserts and samples of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions import sentiment as S
from aspectra.functions import text as T


def scorecard(df: DataFrame, sentiments: str, keys: list[str], aspects: tuple[str, ...] = S.ASPECTS, default: float = 50.0) -> DataFrame:
    """One row per group and aspect: score 0-100, review_count, shares of the votes, has_mixed.

    A row mentions an aspect once and votes with each of its labels.  The typed
    map is read by fixed aspects, so an aspect that no row has is there with the
    default score; everything is one aggregation over partial sums.
    """
    cell = lambda a: F.try_element_at(F.col(sentiments), F.lit(a))
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(a).alias("aspect"), cell(a).alias("cell")) for k, a in enumerate(aspects)])).alias("x"))
    said = F.coalesce(F.col("x.cell.mentioned"), F.lit(False))
    votes = lambda p: F.sum(F.when(said, F.size(F.filter("x.cell.sentiments", lambda s: s == p))).otherwise(0))
    known = F.size(F.filter("x.cell.sentiments", lambda s: s.isin(*S.POLARITIES)))
    sums = long.groupBy(*keys, F.col("x.aspect").alias("aspect")).agg(
        F.count_if(said).alias("review_count"), *[votes(p).alias(p) for p in S.POLARITIES], F.max(F.when(said, known > 1).otherwise(F.lit(False))).alias("has_mixed")
    )
    total = F.col("NEG") + F.col("POS") + F.col("NEU")
    share = lambda p: F.when(total > 0, F.bround(100.0 * F.col(p) / total, 1))
    return sums.select(
        *keys,
        "aspect",
        F.when(total > 0, F.bround((100.0 * F.col("POS") + 50.0 * F.col("NEU")) / total, 1)).otherwise(F.lit(default)).alias("score"),
        "review_count",
        share("POS").alias("pct_pos"),
        share("NEG").alias("pct_neg"),
        share("NEU").alias("pct_neu"),
        "has_mixed",
    )


def plain_scores(df: DataFrame, legacy: str, keys: list[str], aspects: tuple[str, ...] = S.ASPECTS, default: float = 50.0) -> DataFrame:
    """Mean of 100 / 50 / 0 over a map of legacy codes, 2 left out."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.try_element_at(F.col(legacy), F.lit(a)).alias("code")) for a in aspects])).alias("x"))
    points = F.when(F.col("x.code") == 1, 100).when(F.col("x.code") == 0, 50).when(F.col("x.code") == -1, 0)
    return long.groupBy(*keys, F.col("x.aspect").alias("aspect")).agg(F.coalesce(F.bround(F.sum(points) / F.count(points), 1), F.lit(default)).alias("score"))


def polarity_summary(df: DataFrame, sentiments: str, keys: list[str], aspects: tuple[str, ...] = S.ASPECTS) -> DataFrame:
    """Counts of positive, negative and neutral labels of mentioned cells, zeros kept."""
    card = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.try_element_at(F.col(sentiments), F.lit(a))["sentiments"].alias("s")) for a in aspects])).alias("x"))
    count = lambda p: F.sum(F.coalesce(F.size(F.filter("x.s", lambda s: s == p)), F.lit(0)).cast("long"))
    return card.groupBy(*keys, F.col("x.aspect").alias("aspect")).agg(count("POS").alias("positive"), count("NEG").alias("negative"), count("NEU").alias("neutral"))


def kpi(df: DataFrame, legacy: str, aspects: tuple[str, ...] = S.ASPECTS) -> DataFrame:
    """Reviews, mean sentiment on 0-100 and share of positive cells over all cells but 2."""
    codes = F.array(*[F.try_element_at(F.col(legacy), F.lit(a)) for a in aspects])
    own = df.select(F.filter(codes, lambda c: c.isNotNull() & (c != 2)).alias("c"))
    sums = own.agg(
        F.count("*").alias("total_reviews"),
        F.sum(F.size("c")).alias("n"),
        F.sum(F.aggregate("c", F.lit(0), lambda s, v: s + v)).alias("s"),
        F.sum(F.size(F.filter("c", lambda v: v == 1))).alias("p"),
    )
    n = F.coalesce("n", F.lit(0))
    return sums.select(
        "total_reviews",
        F.when(n > 0, (F.col("s") / n + 1) * 50).otherwise(0.0).alias("avg_sentiment"),
        (100.0 * F.coalesce("p", F.lit(0)) / F.greatest(n, F.lit(1))).alias("positive_rate"),
    )


def keep_first(df: DataFrame, key: Column, order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an explicit order; the planner keeps one row a key before the shuffle."""
    way = [c.desc() for c in order] if last else order
    return df.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*way))).where("_n = 1").drop("_k", "_n")


def fuzzy_dedup(df: DataFrame, text: str, order: list[Column], compat: bool = False) -> DataFrame:
    """Keep-first on the fuzzy key.  Texts without content are dropped before, or after in ``compat`` (where they may take the group ``''`` with them)."""
    filled = F.length(T.strip(F.col(text))) > 0
    start = df if compat else df.where(filled)
    return keep_first(start, T.dedup_key(F.col(text)), order).where(filled)


def new_rows(new: DataFrame, old: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows to append: unseen ids, the first of each id; rows without id always."""
    fresh = new.join(old.select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    keyed = fresh.where(F.col(key).isNotNull()).withColumn("_n", first).where("_n").drop("_n")
    return keyed.unionByName(fresh.where(F.col(key).isNull()))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def balanced_sample(df: DataFrame, rating: str, order: list[Column], n: int) -> DataFrame:
    """Low stars first with a quota each, then as many high ones as low, 4 before 5; without low stars the first n.

    Ranks stop at the quota, which bounds every group; the counts that steer the
    cascade are one row.
    """
    quota = max(10, n // 5)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(rating).orderBy(*order))).where(F.col("_n") <= max(n, 3 * quota))
    found = ranked.agg(
        *[F.count_if((F.col(rating) == s) & (F.col("_n") <= quota)).alias(f"_low{s}") for s in (1, 2, 3)], F.count_if(F.col(rating) == 4).alias("_four")
    ).withColumn("_low", F.col("_low1") + F.col("_low2") + F.col("_low3"))
    half = F.greatest(F.lit(5), F.floor(F.col("_low") / 2))
    fours = F.least(F.col("_four"), F.least(half, F.col("_low")))
    fives = F.least(half, F.col("_low") - fours)
    take = F.when(F.col(rating) <= 3, quota).when(F.col(rating) == 4, fours).when(F.col(rating) == 5, fives).otherwise(0)
    joined = ranked.crossJoin(F.broadcast(found))  # one row
    rank = Window.orderBy(F.when(F.col("_low") > 0, F.col(rating)).otherwise(0), *order)
    own = joined.where((F.col("_low") == 0) | (F.col("_n") <= take)).withColumn("_place", F.row_number().over(rank))
    return own.where(F.col("_place") <= n).select(*df.columns)

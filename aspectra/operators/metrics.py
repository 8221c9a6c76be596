"""Model quality: F1 variants, confusion, percentiles, chi square, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def binary_macro(truth: Column, pred: Column) -> Column:
    """Mean of the F1 of class 0 and of class 1."""
    n = lambda t, p: F.count_if((truth == t) & (pred == p))
    return (f1(n(1, 1), n(0, 1), n(1, 0)) + f1(n(0, 0), n(1, 0), n(0, 1))) / 2


def samples_f1(truth: Column, pred: Column) -> Column:
    """Mean over rows of 2|T and P| / (|T| + |P|), 0 for two empty sets."""
    total = F.size(truth) + F.size(pred)
    return F.avg(F.when(total > 0, 2.0 * F.size(F.array_intersect(truth, pred)) / total).otherwise(0.0))


def micro_f1(truth: Column, pred: Column) -> Column:
    both = F.sum(F.size(F.array_intersect(truth, pred)))
    return f1(both, F.sum(F.size(pred)) - both, F.sum(F.size(truth)) - both)


def evaluate(df: DataFrame, truth: str, pred: str, truth_set: str, pred_set: str) -> DataFrame:
    """One row of a model's measures: mention F1 (macro), sentiment F1 by sample and micro over true mentions, their mean, accuracy.

    ``truth`` and ``pred`` are 0 or 1 by cell, the sets the labels of a cell.
    """
    said = F.col(truth) == 1
    t, p = F.when(said, F.col(truth_set)), F.when(said, F.col(pred_set))
    total = F.size(t) + F.size(p)
    sampled = F.avg(F.when(said, F.when(total > 0, 2.0 * F.size(F.array_intersect(t, p)) / total).otherwise(0.0)))
    both, n_pred, n_true = (F.sum(F.when(said, F.size(x))) for x in (F.array_intersect(t, p), p, t))
    macro = binary_macro(F.col(truth), F.col(pred))
    return df.agg(
        F.count("*").alias("n"),
        macro.alias("mention_f1"),
        sampled.alias("sentiment_f1"),
        f1(both, n_pred - both, n_true - both).alias("micro_f1"),
        ((macro + sampled) / 2).alias("combined_f1"),
        F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"),
    )


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def weighted_prf(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and precision, recall, F1 weighted by true counts, from the confusion counts."""
    cells = confusion(df, truth, pred)
    by_true = cells.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col(pred).alias("c")).agg(F.sum("n").alias("p"))
    own = by_true.join(by_pred, "c", "left").fillna(0, ["p"])
    precision = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    recall = F.col("tp") / F.col("t")
    mean = lambda x: F.sum(F.col("t") * x) / F.sum("t")
    return own.agg(
        (F.sum("tp") / F.sum("t")).alias("accuracy"),
        mean(precision).alias("precision"),
        mean(recall).alias("recall"),
        mean(f1(F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp"))).alias("f1"),
    )


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at rank round((n - 1) * p), half to even.

    Counts of distinct values are summed up first; ranks come from running sums
    within buckets of values, so no task sees all of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    bounds = ranks.edges(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), "v", ranks.width(df))
    upto = ranks.running(counts, "v", "hi", weight="c", bounds=bounds)
    total = counts.agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    at = lambda p: F.bround((F.col("n") - 1) * F.lit(p), 0)
    pick = lambda p: F.max(F.when((at(p) < F.col("hi")) & (at(p) >= F.col("hi") - F.col("c")), F.col("v")))
    return upto.crossJoin(F.broadcast(total)).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *[pick(p).alias(k) for k, p in shares.items()])


def chi_square(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """``cells(feature, label, n)`` feature sums by class and ``classes(label, share)``: (feature, chi2).

    Observed sums against the feature's total spread by the class shares.
    """
    totals = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(classes)).join(cells, ["feature", "label"], "left").fillna(0, ["n"])
    expected = F.col("total") * F.col("share")
    return grid.groupBy("feature").agg(F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("chi2"))


def better_by(new: Column, old: Column, least: float = 0.01) -> Column:
    """Whether a model is promoted; a tie within the margin keeps the old one."""
    return F.round(new - old, 9) >= least

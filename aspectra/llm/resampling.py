"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two generative models over ``BUCKETS`` hashed features, the target's from
labelled good documents and the raw one from all documents, give every document
the mean log ratio of its features.  Features are one- and two-word grams and
one- and two-word grams of word shapes (case, last byte, length, repeats the
word before).  Documents are drawn without replacement with weights
exp(SHARPNESS * mean log ratio): the k largest of log weight plus Gumbel noise,
the noise fixed by doc_id and seed.  By default k is the number of documents
whose mean log ratio reaches ``LEAST``, counted over all documents.

The labelled sample is bounded by ``SAMPLE`` (the labels with the smallest
hashes); every other count covers every row and the whole text.  To the driver
come at most ``BUCKETS`` sums and, for the k-th key, counts of a fixed number of
bins.  Without labelled documents both models agree and all weights are equal.
A null or empty text has no feature and mean 0; rows without doc_id share one
noise; repeated rows are drawn alike except where the k-th key ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import about, broadcast_if_small, materialize, unused
from .words import mix, sliced, text_words

BUCKETS = 1 << 16
SAMPLE = 20_000
SHARPNESS = 200.0
LEAST = -0.25
PRIOR = 16  # features without evidence that each text is credited with
SCALE = 1_000_000
_U = np.uint64


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text number) of all features of all texts."""
    w = text_words(column)
    if not len(w.text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = np.zeros(len(w.text), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    case = np.where(w.capitals == 0, 0, np.where(w.capitals == 1, 1, 2))
    symbol = np.where((w.last < 48) | ((w.last > 57) & (w.last < 65)) | ((w.last > 90) & (w.last < 97)), w.last, 0)
    shape = ((case * 2 + again) * 256 + symbol) * 8 + np.minimum(w.size // 4, 7)
    shapes = mix(shape.astype(_U) + _U(1 << 32))
    pair = np.flatnonzero(w.text[1:] == w.text[:-1])
    factor, other = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
    out = [w.hashes, mix(w.hashes[pair] * factor + w.hashes[pair + 1]), shapes, mix(shapes[pair] * other + shapes[pair + 1])]
    at = [w.text, w.text[pair], w.text, w.text[pair]]
    return (np.concatenate(out) & _U(BUCKETS - 1)).astype(np.int64), np.concatenate(at)


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def good_ids(labels: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` ids of good, not toxic documents: those with the smallest hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    key = F.xxhash64("doc_id")
    return np.sort(np.array([r[0] for r in about(good, key, most).orderBy(key, "doc_id").limit(most).collect()], np.int64))


def log_ratios(docs: DataFrame, good: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, counts plus one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches, most=1 << 20):
            own, text = features(batch.column("text"))
            raw += np.bincount(own, minlength=BUCKETS)
            chosen = pc.is_in(batch.column("doc_id"), value_set=pa.array(good, pa.int64())).to_numpy(zero_copy_only=False)  # never a null id
            target += np.bincount(own[chosen[text]], minlength=BUCKETS)
        k = np.flatnonzero(raw)
        if len(k):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(k), "raw": pa.array(raw[k]), "target": pa.array(target[k])})

    sums = _named(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if len(good) else np.zeros(BUCKETS)


def means(column: pa.Array, ratios: np.ndarray) -> np.ndarray:
    own, text = features(column)
    n = np.bincount(text, minlength=len(column))
    return np.bincount(text, ratios[own], len(column)) / (n + PRIOR)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = (mix(ids.astype(np.int64).view(_U) + mix(np.full(1, seed, _U))) >> _U(11)).astype(float) + 0.5
    return -np.log(-np.log(u / (1 << 53)))


SCORE_SCHEMA = "doc_id long, text_hash long, log_ratio double, draw long"


def score(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, text_hash, log_ratio and draw (log weight plus noise, in whole millionths) of every row; texts do not come back."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            m = means(batch.column("text"), ratios)
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            draw = np.rint((SHARPNESS * m + gumbel(ids, seed)) * SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(m), pa.array(draw)], names=["doc_id", "text_hash", "log_ratio", "draw"])

    return _named(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(scored, SCORE_SCHEMA)


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(v, r): the k-th largest value of a long column is v, and r of the rows that equal v are among the k.

    Digit by digit: each round counts 2048 bins of the range that still matters.
    """
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        width = -(-(high - low + 1) // 2048)
        inside = df.where(F.col(column).between(low, high))
        bins = inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("long").alias("bin")).count().orderBy(F.desc("bin")).collect()
        for r in bins:
            if k <= r["count"]:
                break
            k -= r["count"]
        low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
    return low, k


def select(scored: DataFrame, k: int | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``scored`` that Gumbel top-k draws; ``k`` None: as many as reach ``least``."""
    k = scored.where(F.col("log_ratio") >= least).count() if k is None else min(k, scored.count())
    if k == 0:
        return scored.where("false")
    value, ties = kth_largest(scored, "draw", k)
    above = scored.where(F.col("draw") > value)
    equal = scored.where(F.col("draw") == value).withColumn("_n", F.row_number().over(Window.partitionBy("draw").orderBy("doc_id")))
    return above.unionByName(equal.where(F.col("_n") <= ties).drop("_n"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The documents drawn: doc_id, log_ratio, draw."""
    ratios = log_ratios(docs, good_ids(labels))
    return select(materialize(score(docs, ratios, seed), "scored"), k).drop("text_hash")


def filter_documents(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns; all rows whose key equals the k-th stay.

    Only keys of rejected rows meet the documents, broadcast where their number is
    checked and joined by key otherwise; a null id equals only a null id.
    """
    small = materialize(score(docs, log_ratios(docs, good_ids(labels)), seed), "scored")
    k = small.where(F.col("log_ratio") >= LEAST).count()
    if k == 0:
        return docs.where("false")
    value, _ = kth_largest(small, "draw", k)
    own, none, mark = unused(docs, "id", "none", "hash")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(own), F.col("doc_id").isNull().alias(none)]
    gone = materialize(small.where(F.col("draw") < value).select(*key, F.col("text_hash").alias(mark)).distinct(), "rejected")
    keyed = docs.select("*", *key, F.xxhash64(F.coalesce("text", F.lit(""))).alias(mark))
    return keyed.join(broadcast_if_small(gone), [own, none, mark], "left_anti").select(docs.columns)

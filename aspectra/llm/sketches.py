"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct shingle hashes of a text.  The sketch of
a union is made of the sketches of its parts (:func:`merge`), so a document, a
source or a whole corpus can be sketched part by part, in any order, twice over
without harm.  From two sketches follow resemblance (:func:`likeness`),
containment (:func:`containment`) and the distinct shingle count
(:func:`distinct`).

A null or empty text has no shingles and the empty sketch, which is like itself
only; fewer words than a shingle has make one shingle; equal texts have equal
sketches.  Rows may repeat and texts may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import shuffle_width
from .words import distinct_sets, shingle_hashes, sliced

WIDTH = 5
K = 256
BITS = 48
_EMPTY = np.zeros(0, np.uint64)


def sketches(column: pa.Array, width: int = WIDTH, k: int = K) -> list[np.ndarray]:
    """The k smallest distinct hashes, of 48 bits each, of every text."""
    hashes, first = shingle_hashes(column, width, fold=True)
    return [s[:k].copy() for s in distinct_sets(hashes >> np.uint64(64 - BITS), first)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of the union's k smallest hashes that both have; 1 for two empty sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    least = min(k, len(both) - int(np.count_nonzero(twice)))
    place = np.flatnonzero(np.concatenate([[True], ~twice]))
    edge = both[place[least - 1]]
    return int(np.count_nonzero(twice & (both[1:] <= edge))) / least


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, likeness(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """Six bytes a hash, most significant first, in base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint", width: int = WIDTH, k: int = K) -> DataFrame:
    """Add ``into``, the sketch of ``text`` as a string; a column of that name is replaced."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        column = pa.array(texts.fillna(""), pa.large_string())
        return pd.Series([to_text(s) for s in sketches(column, width, k)])

    return df.withColumn(into, made(F.col(text)))


def merged(df: DataFrame, keys: list[str], into: str = "fingerprint", k: int = K, parts: int = 64) -> DataFrame:
    """One sketch for each value of ``keys`` from a column ``fingerprint``.

    Two levels: sketches meet in ``parts`` salted groups first, so a key with a
    third of all rows is shared out; a group is folded batch by batch and what
    it hands on is one sketch.
    """
    salted = df.select(*keys, F.col("fingerprint").alias("_s"), F.pmod(F.xxhash64("fingerprint"), F.lit(parts)).alias("_part"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _EMPTY
        for pdf in batches:
            rows = [from_text(s) for s in pdf["_s"] if s]
            if rows:
                total = np.unique(np.concatenate([total, *rows]))[:k]
        yield pd.DataFrame([[*key[: len(keys)], to_text(total)]], columns=[*keys, "_s"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + ", _s string"
    once = salted.groupBy(*keys, "_part").applyInPandas(fold, schema)
    return once.groupBy(*keys).applyInPandas(fold, schema).withColumnRenamed("_s", into)


def _neighbours(df: DataFrame, buckets: int) -> DataFrame:
    """``df(doc_id, text)`` in buckets of neighbouring ids, each closed by a guest: the document that follows its last.

    Only one id a bucket reaches the driver; every text moves once.
    """
    ids = df.select("doc_id")
    edges = np.unique(np.array(ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets), np.int64))

    def number(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, values, "right")

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(number(values.to_numpy(np.int64)), dtype="int32")

    tops = [r["top"] for r in ids.groupBy(bucket("doc_id").alias("b")).agg(F.max("doc_id").alias("top")).orderBy("top").collect()]
    there = [int(x) for x in number(np.array(tops, np.int64))]
    guests = {top: there[(k + 1) % len(there)] for k, top in enumerate(tops)}

    @F.pandas_udf("array<int>")
    def homes(values: pd.Series) -> pd.Series:
        own = number(values.to_numpy(np.int64))
        return pd.Series([[2 * b, 2 * guests[v] + 1] if v in guests else [2 * b] for v, b in zip(values, own, strict=True)])

    dealt = df.withColumn("home", F.explode(homes("doc_id")))
    dealt = dealt.withColumns({"bucket": F.shiftright("home", 1), "guest": F.col("home") % 2 == 1})
    return dealt.drop("home").repartition(shuffle_width(df.sparkSession), "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "text")


NEIGHBOUR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_neighbours(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Fingerprint each text, its edited text and its next document (descending doc_id; after the last the first).

    The edited text: the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document.  Of documents with one doc_id
    the text orders them; rows without doc_id come after all others, as if theirs
    were the least long.
    """
    number = F.col("doc_id").cast("long")
    df = docs.select(F.coalesce(number, F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), number.isNotNull().alias("given"))
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], NEIGHBOUR_SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] | None = None
        own: list[np.ndarray] = []
        for batch in sliced(batches):
            got = {c: batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text", "given")}
            prints = sketches(batch.column("text"), width, k)
            if kept:
                got = {c: kept[c] + got[c] for c in got}
                prints = own + prints
            ids, texts, places = got["doc_id"], got["text"], got["bucket"]
            ours = [i for i in range(len(ids) - 1) if not got["guest"][i] and places[i] == places[i + 1]]
            edited = []
            for i in ours:
                n = len(texts[i])
                edited.append(texts[i][: n - n // 3] + texts[i + 1][: n // 3])
            marks = sketches(pa.array(edited, pa.large_string()), width, k)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[i] if got["given"][i] else None for i in ours], pa.int64()),
                    "n_chars": pa.array([len(texts[i]) for i in ours], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    "fingerprint": pa.array([to_text(prints[i]) for i in ours], pa.string()),
                    "edited_fingerprint": pa.array([to_text(m) for m in marks], pa.string()),
                    "near_edited": pa.array([likeness(prints[i], m, k) for i, m in zip(ours, marks, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(prints[i], prints[i + 1], k) for i in ours], pa.float64()),
                }
            )
            kept, own = {c: got[c][-1:] for c in got}, prints[-1:]

    n = max(2, 2 * shuffle_width(df.sparkSession))
    return _neighbours(df, n).mapInArrow(rows, NEIGHBOUR_SCHEMA)

"""Best-fit packing by patterns fitted with non-negative least squares.

1. Every document becomes pieces of token ids (:func:`pieces`).  Words are
   looked up in a bounded table of words already encoded; the tokenizer only
   sees new ones.  A text outside the plain range goes to the tokenizer whole.
2. Only the histogram of lengths, at most ``capacity`` counts, reaches the
   driver.  :func:`plan` enumerates patterns of one to three lengths that fill
   a sequence, fits how often each repeats by non-negative least squares,
   rounds down, and packs what is left best-fit, largest first, into the gaps
   and new sequences.  The plan is a list of runs: pieces of one length with
   ranks in a range go to consecutive sequences at one offset.
3. A piece's rank among its length is its partition's start plus its place
   there, so a length that a third of all pieces share is not sorted anywhere.
   Pieces meet those starts by (partition, length), never by a broadcast, for
   the starts grow with the number of partitions.

A null or empty text is the one id 1; repeated rows are packed as often as
they occur.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import materialize

CAPACITY = 4096
END_ID = 1
UNIT = 16
CACHE_WORDS = 400_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"

#: How the tokenizer splits a lower-cased text into words, and what may differ between its libraries and ours.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_UNSURE = regex.compile(r"[^\x00-\x1b\x20-ȴ‐-‧‰-⁞€]|<\||[\x85İŉǰ]")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class _Parts(dict):
    """Lower-cased pretoken: its ids, as bytes."""

    def __init__(self, model: object, most: int) -> None:
        self.model, self.most, self.signs = model, most, _byte_signs()

    def made(self, part: str) -> bytes:
        spelled = part if part.isascii() and part.isalpha() else "".join(map(self.signs.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.made(part)
        if len(self) < self.most:
            self[part] = ids
        return ids


class _Words(dict):
    """Lower-cased word between white space: its ids, as bytes."""

    def __init__(self, parts: _Parts, most: int) -> None:
        self.parts, self.most = parts, most

    def __missing__(self, word: str) -> bytes:
        ids = self.parts.made(word) if word.isascii() and word.isalpha() else b"".join(map(self.parts.__getitem__, _SPLIT.findall(word)))
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    """Token ids as little-endian bytes of four each, equal to the tokenizer's own."""

    def __init__(self, path: str, words: int = CACHE_WORDS) -> None:
        """``words``: the most that are kept encoded."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(_Parts(self.tokenizer.model, words // 2), words)

    def encode(self, text: str) -> bytes:
        if text.isascii():
            plain = "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            plain = not _UNSURE.search(text) and unicodedata.is_normalized("NFC", text)
        if plain:
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, words: int = CACHE_WORDS) -> Encoder:
    """One encoder a Python worker, kept from task to task; its words are bounded."""
    if (path, words) not in _encoders:
        _encoders.clear()
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, words: int = CACHE_WORDS) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with their number in their partition among equal lengths."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer_path, words).encode, defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                ids, texts = (batch.column(c).slice(low, 500).to_pylist() for c in ("doc_id", "text"))
                out: list[tuple] = []
                for doc, text in zip(ids, texts, strict=True):
                    data = encode(text or "") + end
                    for k in range(0, len(data), 4 * capacity):
                        own = data[k : k + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc, k // (4 * capacity), k // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """Every way to fill ``size`` units with one to three lengths of which there are any; unused slots are 0."""
    there = np.flatnonzero(counts[: size + 1])
    there = there[there > 0]
    has = np.zeros(size + 1, bool)
    has[there] = True
    found = [[size, 0, 0]] if has[size] else []
    for a in there:
        b = there[(there <= a) & (there <= size - a)]
        rest = size - a - b
        ok = (rest <= b) & ((rest == 0) | has[rest])
        found += [[int(a), int(x), int(size - a - x)] for x in b[ok]]
    return np.array(found, np.int64).reshape(-1, 3)


def fit_repeats(pats: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that least-square the histogram, by accelerated projected gradient.

    A length's residual weighs with its size, for a long piece left over costs most of a sequence.
    """
    size = len(counts) - 1
    weight = np.arange(size + 1, dtype=float) / size
    weight[0] = 0
    flat = pats.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), size + 1) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[pats].sum(1)

    target = counts * weight
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(forward(v))
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - target) / (1.01 * step))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan(hist: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences."""
    size = capacity // unit
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    sequences = 0
    bins: list[list[list[int]]] = [[] for _ in range(size + 1)]  # of each bin: [length, count left], longest first
    for length in sorted(hist, reverse=True):
        bins[-(-length // unit)].append([length, hist[length]])
    counts = np.array([sum(c for _, c in b) for b in bins])
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap: [first sequence, count]

    def take(b: int, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, left = bins[b][0]
            k = min(n, left)
            out.append((length, used[length], k))
            used[length] += k
            n -= k
            bins[b][0][1] -= k
            if k == left:
                bins[b].pop(0)
        return out

    pats = patterns(counts, size)
    if len(pats):
        repeats = fit_repeats(pats, counts)
        left = counts.copy()
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] < 1:
                break
            need = np.bincount(pats[k], minlength=size + 1)
            need[0] = 0
            own = np.flatnonzero(need)
            n = int(min(repeats[k], *(left[own] // need[own])))
            if n <= 0:
                continue
            left[own] -= n * need[own]
            slots = [take(int(b), n) for b in pats[k] if b]
            while slots[0]:
                m = min(s[0][2] for s in slots)
                offset = 0
                for j, s in enumerate(slots):
                    length, rank, c = s[0]
                    runs.append((length, rank, m, sequences, offset))
                    offset += length
                    if c == m:
                        s.pop(0)
                    else:
                        s[0] = (length, rank + m, c - m)
                if offset < capacity:
                    gaps[capacity - offset].append([sequences, m])
                sequences += m
    open_gaps = np.zeros(capacity + 1, bool)
    for g in gaps:
        open_gaps[g] = True
    for b in range(size, 0, -1):
        for length, n in bins[b]:
            while n:
                near = int(np.argmax(open_gaps[length:]))
                gap = length + near if open_gaps[length + near] else capacity
                fresh = gap == capacity and not open_gaps[capacity]
                each = gap // length
                m = min(n // each, 1 << 62 if fresh else gaps[gap][-1][1])
                if not m:
                    m, each = 1, n
                if fresh:
                    first = sequences
                    sequences += m
                else:
                    group = gaps[gap][-1]
                    group[1] -= m
                    first = group[0] + group[1]
                    if not group[1]:
                        gaps[gap].pop()
                        open_gaps[gap] = bool(gaps[gap])
                for j in range(each):
                    runs.append((length, used[length], m, first, capacity - gap + j * length))
                    used[length] += m
                n -= m * each
                rest = gap - each * length
                if rest:
                    gaps[rest].append([first, m])
                    open_gaps[rest] = True
    return runs, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, words: int = CACHE_WORDS) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``words``: the encoded words that a worker keeps, time against memory.
    """
    cut = materialize(pieces(docs, tokenizer_path, capacity, words), "pieces")
    sums = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(sums.withColumn("before", F.coalesce(before, F.lit(0))), "starts")
    hist = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(hist, capacity)
    runs.sort()
    length, rank, count, first, offset = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [[]] * 5))
    key = (length << 44) + rank
    ranked = cut.join(starts.drop("n").hint("merge"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(key, (own << 44) + r, "right") - 1
            columns = [*batch.columns[:5], pa.array(first[k] + r - rank[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Exact substring dedup: suffixes sorted block by block, long ties settled by cover-sample ranks.

Every byte that a ``LENGTH``-byte string covers goes if that string also starts
in a document with a smaller id.

1. Anchors.  Of the ``GRAM``-byte grams in a string of LENGTH bytes the one with
   the least hash (the leftmost of equals) is its anchor; equal strings have
   equal anchors at equal places.  Anchors of all documents meet by hash, packed
   in a few bytes each; what only one document has is done with.  An anchor that
   several documents of a batch have is known to be shared: the batch sends it
   once, so a passage in a third of all documents is one entry a batch.
2. Contexts.  For each shared anchor a document sends the bytes of all strings
   that it anchors (LENGTH + SPAN - 1 at most).  A batch sends equal contexts
   once, for the smallest id; the others are known to go.
3. Blockwise sort.  A task holds the contexts of some anchors, laid out around
   the anchor, and takes one suffix bucket (one start column) after the other.
   Start columns in the difference cover 0, 1, 3, 9 mod 13 are ranked first,
   from right to left; any other suffix is sorted by the few bytes up to the
   next cover column and then by that column's rank, so ties of any length cost
   one comparison and memory is one bucket.  Neighbours that agree in LENGTH
   bytes form a class; all but those of its smallest id go.

Contexts of one anchor that differ stay together, so memory grows with the
number of different surroundings of the most frequent passage, not with its
copies.  A null text is empty.  Rows that repeat a doc_id remove nothing from one
another and are told apart by their texts; rows without doc_id come after all
others, as one id that is larger than any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import materialize, release, row_key, shuffle_width
from .words import mix, packed, sliced, trim, unpacked, utf8

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
WIDE = LENGTH + SPAN - 1
COVER = (0, 1, 3, 9)
PERIOD = 13
SEGMENT = 1 << 23
BLOCK = 1 << 14
ROWS = 1 << 12
_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte; beyond the end zeros follow."""
    padded = np.concatenate([raw, np.zeros(GRAM + 8, np.uint8)])
    words = np.ndarray(len(raw) + GRAM, "<u8", padded, strides=(1,))
    h = np.zeros(len(raw), _U)
    factors = mix(np.arange(1, 2 + GRAM // 8, dtype=_U)) | _U(1)
    for f, at in zip(factors, (*range(0, GRAM - 7, 8), GRAM - 8), strict=True):
        h += words[at : at + len(raw)] * f
    return mix(h)


class Anchored:
    """The anchored string starts of a stretch of bytes: text number, [low, high], place of the anchor, its hash."""

    def __init__(self, at: np.ndarray, raw: np.ndarray) -> None:
        """``at``: starts of the texts in ``raw``, with the end."""
        parts: list[tuple] = []
        for k, low, high in self._segments(at):
            own = raw[low:high]
            edges = np.clip(at[k[0] : k[1] + 1], low, high) - low
            parts.append(self._runs(own, edges, k[0], low))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U)]
        self.text, self.low, self.high, self.place, self.hash = columns

    @staticmethod
    def _segments(at: np.ndarray) -> Iterator[tuple[tuple[int, int], int, int]]:
        """Whole texts together, or stretches of one long text that overlap so that no start is lost."""
        k, n = 0, len(at) - 1
        while k < n:
            end = max(k + 1, int(np.searchsorted(at, at[k] + SEGMENT, "right")) - 1)
            if at[end] - at[k] <= SEGMENT:
                yield (k, end), int(at[k]), int(at[end])
            else:
                for low in range(int(at[k]), int(at[end]), SEGMENT):
                    yield (k, end), low, min(low + SEGMENT + LENGTH - 1, int(at[end]))
            k = end

    @staticmethod
    def _runs(own: np.ndarray, edges: np.ndarray, first: int, low: int) -> tuple:
        if len(own) < LENGTH:
            return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, _U))
        h = _grams(own)
        least = (h & ~_PLACE) | np.arange(len(own), dtype=_U)
        step = 1
        while 2 * step <= SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - step)], least[SPAN - step :])
        least = least[: len(own) - LENGTH + 1]
        place = (least & _PLACE).astype(np.int64)
        valid = np.zeros(len(least) + 1, np.int32)  # starts whose string ends within their text
        size = np.diff(edges)
        ok = size >= LENGTH
        np.add.at(valid, edges[:-1][ok], 1)
        np.add.at(valid, edges[1:][ok] - LENGTH + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        new = np.ones(len(least), bool)
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        new[edges[:-1][(edges[:-1] < len(new))]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(least)) - 1
        use = valid[starts]
        starts, ends = starts[use], ends[use]
        text = np.searchsorted(edges, starts, "right") - 1 + first
        # Least hashes crowd near zero; mixed once more they spread evenly over buckets.
        return text, starts + low, ends + low, place[starts] + low, mix(h[place[starts]] + _U(0x9E3779B97F4A7C15))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, rank, raw): ``row`` names a row, or rows of one id and text; ``rank`` is compared: the id, or the largest long."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), row_key(docs)[0].alias("row"), F.coalesce(own, F.lit((1 << 63) - 1)).alias("rank"), raw.alias("raw"))


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each stretch of a sorted array of bucket numbers."""
    ends = np.searchsorted(bucket, np.arange(buckets), "right")
    starts = np.concatenate([[0], ends[:-1]])
    for b in np.flatnonzero(ends > starts):
        yield int(b), int(starts[b]), int(ends[b])


def binaries(items: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose k-th value holds the next ``counts[k]`` rows of ``items``, numbers of eight bytes."""
    items = np.ascontiguousarray(items)
    size = items.dtype.itemsize * (items.shape[1] if items.ndim > 1 else 1)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * size, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(items.tobytes())]).cast(pa.binary())


def _by_text(x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(texts, the hashes of each)."""
    order = np.argsort(text, kind="stable")
    names, counts = np.unique(text, return_counts=True)
    return names, binaries(x[order], counts)


ANCHOR_SCHEMA = "bucket int, hashes binary, texts binary, rows binary, ranks binary, row long, anchors binary"


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, anchors): packed hashes of the anchors that a row shares with one of another rank."""

    shift = _U(64 - buckets.bit_length() + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "raw", most=1 << 20, rows=4000):
            at, raw = utf8(batch.column("raw"))
            found = Anchored(at, raw)
            ids = [batch.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "rank")]
            order = np.lexsort((found.text, found.hash))
            x, text = found.hash[order], found.text[order]
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
            x, text = x[keep], text[keep]
            start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            rank = np.frombuffer(ids[1], np.int64)[text]
            several = np.minimum.reduceat(rank, start) != np.maximum.reduceat(rank, start) if len(x) else np.zeros(0, bool)
            known = np.repeat(several, np.diff(np.append(start, len(x))))
            names = [c.split()[0] for c in ANCHOR_SCHEMA.split(", ")]
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.binary()]
            if known.any():
                texts, hashes = _by_text(x[known], text[known])
                own = np.frombuffer(ids[0], np.int64)[texts]
                none = pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((own % buckets).astype(np.int32)), *[none] * 4, pa.array(own), hashes], names=names)
            columns: list[list] = [[] for _ in range(7)]
            sent = ~known
            sent[start] = True
            x, text = x[sent], text[sent]
            for b, i, j in _split((x >> shift).astype(np.int64), buckets):
                # mostly ids name the rows
                row_ = (b, packed(x[i:j]), text[i:j].astype(np.uint16).tobytes(), ids[0], ids[1] if ids[1] != ids[0] else None, None, None)
                for c, v in zip(columns, row_, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def meet(group: pa.Table) -> pa.Table:
        known = group.filter(group.column("row").is_valid()).select(["row", "anchors"])
        group = group.filter(group.column("row").is_null())
        found = met(group) if group.num_rows else known.slice(0, 0)
        return pa.concat_tables([known.cast(found.schema), found])

    def met(group: pa.Table) -> pa.Table:
        hashes, owners, compared = [], [], []
        for h, t, i, r in zip(*(group.column(c).to_pylist() for c in ("hashes", "texts", "rows", "ranks")), strict=True):
            hashes.append(unpacked(h))
            own = np.frombuffer(t, np.uint16)
            owners.append(np.frombuffer(i, np.int64)[own])
            compared.append(owners[-1] if r is None else np.frombuffer(r, np.int64)[own])
        x, doc, rank = np.concatenate(hashes), np.concatenate(owners), np.concatenate(compared)
        order = np.argsort(x)
        x, doc, rank = x[order], doc[order], rank[order]
        start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        several = np.minimum.reduceat(rank, start) != np.maximum.reduceat(rank, start)
        keep = np.repeat(several, np.diff(np.append(start, len(x))))
        x, doc = x[keep], doc[keep]
        rows, own = _by_text(x, doc)
        return pa.table({"row": pa.array(rows), "anchors": own})

    sent = docs.mapInArrow(send, ANCHOR_SCHEMA)
    return sent.groupBy("bucket").applyInArrow(meet, "row long, anchors binary")


CONTEXT_SCHEMA = "bucket int, hashes binary, docs binary, ranks binary, lows binary, sizes binary, lefts binary, bytes binary, row long, gone binary"


def contexts(joined: DataFrame, buckets: int) -> DataFrame:
    """What ``joined(row, rank, raw, anchors)`` sends to the sort: contexts, and (records with a row) byte ranges already known to go."""
    shift = _U(64 - buckets.bit_length() + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, "raw", most=1 << 20, rows=4000):
            at, raw = utf8(batch.column("raw"))
            ids, ranks = (batch.column(c).to_numpy() for c in ("row", "rank"))
            found = Anchored(at, raw)
            packs = batch.column("anchors")
            each = packs.flatten()
            sizes = pc.binary_length(each).to_numpy().astype(np.int64) // 8
            owner = np.repeat(np.repeat(np.arange(len(ids)), pc.list_value_length(packs).to_numpy()), sizes)
            known_hashes = utf8(each)[1].copy().view(_U) if len(each) else np.zeros(0, _U)
            # text and hash in one number; were two alike, a context more would be sent
            shared = np.isin(found.hash ^ mix(found.text.astype(_U) + _U(1)), known_hashes ^ mix(owner.astype(_U) + _U(1)))
            pick = np.flatnonzero(shared)
            text, low, size = found.text[pick], found.low[pick], found.high[pick] - found.low[pick] + LENGTH
            left, x = found.place[pick] - low, found.hash[pick]
            content = [raw[a : a + n].tobytes() for a, n in zip(low.tolist(), size.tolist(), strict=True)]
            first: dict[tuple, int] = {}
            known = np.zeros(len(pick), bool)
            for j in np.lexsort((low, ranks[text])).tolist():  # the smallest id comes first
                k = first.setdefault((int(x[j]), int(left[j]), content[j]), j)
                if k != j:
                    known[j] = ranks[text[k]] < ranks[text[j]]
            # A further copy in the same document has the same fate as the first, so it is sent as well unless its fate is known.
            sent = np.flatnonzero(~known)
            sent = sent[np.argsort(x[sent], kind="stable")]
            named = np.array_equal(ids, ranks)  # mostly ids name the rows
            columns: list[list] = [[] for _ in range(10)]
            for b, i, j in _split((x[sent] >> shift).astype(np.int64), buckets):
                own = sent[i:j]
                row = (
                    b,
                    packed(x[own]),
                    ids[text[own]].astype(np.int64).tobytes(),
                    None if named else ranks[text[own]].astype(np.int64).tobytes(),
                    (low[own] - at[text[own]]).astype(np.int64).tobytes(),
                    size[own].astype(np.uint8).tobytes(),
                    left[own].astype(np.uint8).tobytes(),
                    squeeze.compress(b"".join([content[k] for k in own.tolist()])),
                    None,
                    None,
                )
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int32(), *[pa.binary()] * 7, pa.int64(), pa.binary()]
            names = [c.split()[0] for c in CONTEXT_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            if known.any():
                texts, spans = ranges_of(text[known], np.column_stack([low[known] - at[text[known]], low[known] - at[text[known]] + size[known]]))
                none = pa.nulls(len(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((ids[texts] % buckets).astype(np.int32)), *[none] * 7, pa.array(ids[texts]), spans], names=names)

    return joined.mapInArrow(send, CONTEXT_SCHEMA)


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, not touching ranges that cover the same bytes."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    start = np.flatnonzero(new)
    return np.column_stack([spans[start, 0], reach[np.append(start[1:], len(spans)) - 1]])


def ranges_of(owner: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(owners, :func:`joined_spans` of each as bytes), all owners at once."""
    order = np.lexsort((spans[:, 0], owner))
    owner, spans = owner[order], spans[order].astype(np.int64)
    names, number = np.unique(owner, return_inverse=True)
    far = number * (int(spans[:, 1].max(initial=0)) + 1)  # owners do not reach into one another
    reach = np.maximum.accumulate(spans[:, 1] + far)
    new = np.ones(len(owner), bool)
    new[1:] = spans[1:, 0] + far[1:] > reach[:-1]
    start = np.flatnonzero(new)
    joined = np.column_stack([spans[start, 0], reach[np.append(start[1:], len(owner)) - 1] - far[start]]) if len(start) else spans
    return names, binaries(joined, np.bincount(number[start], minlength=len(names)))


def _sorted_by(high: np.ndarray, text: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bytes a to b of each row, ``high`` rank), and whether each differs from the one before."""
    low = np.zeros(len(text), _U)
    for c in range(a, b):
        low = (low << _U(8)) | text[:, c].astype(_U)
    if high.max(initial=0) < 1 << 16 and b - a <= 6:  # some rows of a block may bear ranks beyond their number
        key = (low << _U(16)) | high.astype(_U)
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((high, low))
        new = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    return order, np.concatenate([[True], new]) if len(order) else np.zeros(0, bool)


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new) - 1
    return out


def repeats(text: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(column, rows whose string at that column also starts in a smaller document), one suffix bucket at a time.

    ``text``: rows of WIDE bytes around an anchor; ``group``: the anchor's number;
    strings of a row start in the columns first to last.
    """
    covers = [c for c in range(WIDE + 1) if c % PERIOD in COVER and c >= 0]
    rank = {WIDE: group.astype(np.int32)}
    ahead = WIDE
    for c in reversed([c for c in covers if c < WIDE]):
        rank[c] = _ranks(*_sorted_by(rank[ahead], text, c, ahead))
        ahead = c
    words = np.ascontiguousarray(text)
    for c in range(SPAN):
        rows = np.flatnonzero((first <= c) & (c <= last))
        if len(rows) < 2:
            continue
        ahead = min(k for k in rank if k >= c)
        order, _ = _sorted_by(rank[ahead][rows], text[rows], c, ahead)
        own = rows[order]
        same = group[own][1:] == group[own][:-1]
        for i in range(0, len(same), ROWS):
            cut = words[own[i : i + ROWS + 1], c : c + LENGTH]
            same[i : i + ROWS] &= (cut[1:] == cut[:-1]).all(1)
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(doc[own], start)
        gone = doc[own] > np.repeat(least, np.diff(np.append(start, len(own))))
        if gone.any():
            yield c, own[gone]


def removed(sent: DataFrame) -> DataFrame:
    """(row, gone): byte ranges that the sort of each bucket removes, and those known before."""

    def sort(group: pa.Table) -> pa.Table:
        known = group.filter(group.column("row").is_valid()).select(["row", "gone"])
        group = group.filter(group.column("row").is_null())
        found = sort_contexts(group) if group.num_rows else known.slice(0, 0)
        trim()
        return pa.concat_tables([known.cast(found.schema), found])

    def sort_contexts(group: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        for h, d, r, lo, n, left, squeezed in zip(*(group.column(c).to_pylist() for c in ("hashes", "docs", "ranks", "lows", "sizes", "lefts", "bytes")), strict=True):
            size = np.frombuffer(n, np.uint8).astype(np.int64)
            parts.append((unpacked(h), np.frombuffer(d, np.int64), np.frombuffer(d if r is None else r, np.int64), np.frombuffer(lo, np.int64), size, np.frombuffer(left, np.uint8).astype(np.int64), np.frombuffer(zstandard.decompress(squeezed), np.uint8)))
        x, doc, rank, low, size, left, flat = (np.concatenate(c) for c in zip(*parts, strict=True))
        at = np.cumsum(size) - size
        order = np.argsort(x)
        new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
        edges = np.append(np.flatnonzero(new), len(x))
        docs, spans = [], []
        k = 0
        while k < len(edges) - 1:  # blocks of whole anchors
            end = max(k + 1, int(np.searchsorted(edges, edges[k] + BLOCK, "right")) - 1)
            own = order[edges[k] : edges[end]]
            first = SPAN - 1 - left[own]  # the anchor stands in column SPAN - 1
            text = np.zeros((len(own), WIDE), np.uint8)
            n = size[own]
            for i in range(0, len(own), ROWS):
                some = slice(i, i + ROWS)
                row = np.repeat(np.arange(len(n[some])), n[some])
                inner = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                text[some][row, first[some][row] + inner] = flat[at[own[some]][row] + inner]
            number = np.cumsum(new[edges[k] : edges[end]]) - 1
            least, most = np.full(len(own), SPAN), np.full(len(own), -1)
            for c, rows in repeats(text, number, first, first + n - LENGTH, rank[own]):
                least[rows] = np.minimum(least[rows], c)
                most[rows] = c
            rows = np.flatnonzero(most >= 0)  # a row's strings overlap one another, so what goes is one range
            start = low[own][rows] - first[rows]
            docs.append(doc[own][rows])
            spans.append(np.column_stack([start + least[rows], start + most[rows] + LENGTH]))
            k = end
        ids, all_spans = np.concatenate(docs), np.concatenate(spans)
        if not len(ids):
            return pa.table({"row": pa.array([], pa.int64()), "gone": pa.array([], pa.binary())})
        rows, gone = ranges_of(ids, all_spans)
        return pa.table({"row": pa.array(rows), "gone": gone})

    return sent.groupBy("bucket").applyInArrow(sort, "row long, gone binary")


KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; their SHA-256 if ``keep`` is false) of every row."""
    spark = docs.sparkSession
    buckets = 2 << max(4, (shuffle_width(spark) - 1).bit_length())
    raws = _texts(docs)
    shared = materialize(shared_anchors(raws.select("row", "rank", "raw"), buckets), "anchors")
    release(spark)
    wanted = shared.groupBy("row").agg(F.collect_list("anchors").alias("anchors"))
    joined = raws.join(wanted, "row").select("row", "rank", "raw", "anchors")
    gone = materialize(removed(contexts(joined, buckets)), "gone")
    release(spark)
    gone = gone.groupBy("row").agg(F.collect_list("gone").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "raw"):
            rows = []
            for doc, raw, packs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "gone")), strict=True):
                spans = joined_spans(np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in packs]) if packs else np.zeros((0, 2), np.int64))
                pieces, at = [], 0
                for a, b in spans.tolist():
                    pieces.append(raw[at:a])
                    at = b
                left = b"".join([*pieces, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(left), len(spans), left if keep else hashlib.sha256(left).digest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = [c.split()[0] for c in KEPT_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return raws.join(gone, "row", "left").select("doc_id", "raw", "gone").mapInArrow(cut, KEPT_SCHEMA)

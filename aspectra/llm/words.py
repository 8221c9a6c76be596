"""Words, shingles and their 64-bit hashes over Arrow string columns, in numpy.

A word is a run of bytes other than space and 0x09-0x0D, lower-cased in A-Z if
asked.  All words of a block are hashed at once: prefix sums of a polynomial
over the bytes give each word's hash as a difference.  Every function is pure,
so any retry of a task gives the same values.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_FOLDED = _SYMBOL.copy()
_FOLDED[65:91] = _SYMBOL[97:123]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column without nulls, copies avoided."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def trim() -> None:
    """Hand free memory back, for a worker stays on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 21, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        at, _ = utf8(batch.column(text))
        k, n = 0, batch.num_rows
        while k < n:
            end = min(k + rows, max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1))
            yield batch.slice(k, end - k)
            k = end
    trim()


def _hashed(raw: np.ndarray, at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of each word of a block."""
    inside = ~_SPACE[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    full = at[1:] > at[:-1]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _grown(len(raw) + 1)
    sums = np.empty(len(raw) + 1, _U)
    sums[0] = 0
    np.cumsum((_FOLDED if fold else _SYMBOL)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(at, starts, "right") - 1, starts, ends


def _blocks(at: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts; a text longer than a block comes in parts cut before white space."""
    k, n = 0, len(at) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, "right")) - 1)
        if end > k + 1 or at[end] - at[k] <= BLOCK:
            yield k, raw[at[k] : at[end]], at[k : end + 1] - at[k]
        else:
            low = at[k]
            while low < at[end]:
                high = min(low + BLOCK, at[end])
                while high < at[end] and not _SPACE[raw[high]]:
                    ahead = np.flatnonzero(_SPACE[raw[high : min(high + BLOCK, at[end])]])
                    high = int(high + ahead[0]) if len(ahead) else min(high + BLOCK, at[end])
                yield k, raw[low:high], np.array([0, high - low])
                low = high
        k = end


@dataclass
class Words:
    """All words of all texts in order: hash (A-Z folded), text number, bytes, capitals A-Z, last byte."""

    hashes: np.ndarray
    text: np.ndarray
    size: np.ndarray
    capitals: np.ndarray
    last: np.ndarray


def text_words(column: pa.Array) -> Words:
    at, raw = utf8(column)
    parts = []
    for k, block, own in _blocks(at, raw):
        if len(block):
            h, text, starts, ends = _hashed(block, own, True)
            big = np.zeros(len(block) + 1, np.int32)
            np.cumsum((block >= 65) & (block <= 90), out=big[1:])
            parts.append((h, text + k, ends - starts, big[ends] - big[starts], block[ends - 1].astype(np.int64)))
    if not parts:
        parts.append((np.zeros(0, _U), *[np.zeros(0, np.int64)] * 4))
    return Words(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def word_hashes(column: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """All words of all texts: (hashes, place of each text's first word with the total at the end)."""
    at, raw = utf8(column)
    parts, counts = [], np.zeros(len(at), np.int64)
    for k, block, own in _blocks(at, raw):
        if len(block):
            h, text, _, _ = _hashed(block, own, fold)
            parts.append(h)
            counts[k + 1 : k + len(own)] += np.bincount(text, minlength=len(own) - 1)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.cumsum(counts)


def shingle_hashes(column: pa.Array, width: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in reading order and each text's first place; fewer words than ``width`` make one shingle, none make none."""
    words, at = word_hashes(column, fold)
    n = np.diff(at)
    padded = np.concatenate([words, np.zeros(width, _U)])
    factors = mix(np.arange(101, 101 + width, dtype=_U))
    made = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(made, out=first[1:])
    place = np.repeat(at[:-1] - first[:-1], made) + np.arange(first[-1])
    size = np.repeat(np.minimum(n, width), made)
    total = size.astype(_U) * factors[0]
    for j in range(width):
        total += np.where(size > j, padded[place + j] * factors[j], _U(0))
    return mix(total), first


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = np.sort(hashes[a:b])
        if len(s) > 1:
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        yield s


def packed(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, their bytes transposed so that empty high bytes squeeze."""
    return np.diff(x, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(_U).ravel(), dtype=_U)

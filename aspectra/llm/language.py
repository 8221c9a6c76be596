"""Language of every byte and document by a bidirectional gated recurrent network.

The network reads UTF-8 bytes of letters in both directions with hidden states
of a few units, labels every position and is trained here, in numpy, by
backpropagation through time.  A text is cut into windows of ``WINDOW`` bytes,
each read from a zero state; every byte of every text is read.  A document's
probability of a language is the mean over all its positions that hold letters.

Training: about ``SAMPLE`` of the labelled texts, equal ones counted once, shared
out over all their languages (of each those with the smallest hashes), with all
their windows; every batch draws its languages evenly and then their windows.
The bound, the seed and the steps are parameters.
Everything the network learns comes from text and the label column.

Null text or text without a letter gives ``und`` with score 0; without labelled
documents every text does.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import materialize
from .words import sliced, utf8

WINDOW = 64
HIDDEN = 8
SAMPLE = 3000
LEAST = 50  # texts of a language that has so many, also beyond SAMPLE
STEPS = 400
RATE = 0.02
BATCH = 256
FOLDS = 5
_LETTER = regex.compile(r"\p{L}")
#: Bytes are 0-255; 256 fills a window that a text does not.
SYMBOLS = 257


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiGru:
    """Two gated recurrent layers over symbols, one each way, and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"E{d}"] = (rng.standard_normal((SYMBOLS, 3 * hidden)) * 0.5).astype(f)  # input weights and biases by symbol
            self.p[f"U{d}"] = (rng.standard_normal((hidden, 3 * hidden)) / hidden**0.5).astype(f)
        self.p["W"] = (rng.standard_normal((2 * hidden, classes)) * 0.3).astype(f)
        self.p["c"] = np.zeros(classes, f)

    def _read(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after every symbol of x (steps, rows)."""
        e, u, n = self.p[f"E{d}"], self.p[f"U{d}"], self.hidden
        h = np.zeros((x.shape[1], n), np.float32)
        states = np.empty((*x.shape, n), np.float32)
        trace = []
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            g = e[x[t]]
            gates = _sigmoid(g[:, : 2 * n] + h @ u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(g[:, 2 * n :] + (r * h) @ u[:, 2 * n :])
            new = h + z * (c - h)
            if keep:
                trace.append((t, h, z, r, c))
            states[t] = h = new
        return states, trace

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, classes) at every position."""
        both = np.concatenate([self._read("f", x, False)[0], self._read("b", x, False)[0]], axis=2)
        s = both @ self.p["W"] + self.p["c"]
        s = np.exp(s - s.max(2, keepdims=True))
        return s / s.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross entropy over positions, and its gradients by backpropagation through time."""
        n = self.hidden
        read = {d: self._read(d, x, True) for d in "fb"}
        both = np.concatenate([read["f"][0], read["b"][0]], axis=2)
        s = both @ self.p["W"] + self.p["c"]
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        rows = np.arange(x.shape[1])
        share = (weight / max(float(weight.sum()), 1e-9)).astype(np.float32)
        loss = -float((np.log(s[:, rows, y] + 1e-9) * share).sum())
        ds = s.copy()
        ds[:, rows, y] -= 1
        ds *= share[..., None]
        out = {"W": np.einsum("trh,trc->hc", both, ds), "c": ds.sum((0, 1))}
        up = ds @ self.p["W"].T
        for d, part in (("f", up[..., :n]), ("b", up[..., n:])):
            u = self.p[f"U{d}"]
            de, du = np.zeros_like(self.p[f"E{d}"]), np.zeros_like(u)
            back = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, c in reversed(read[d][1]):
                dh = part[t] + back
                dc = dh * z * (1 - c * c)
                drh = dc @ u[:, 2 * n :].T
                dz = dh * (c - h) * z * (1 - z)
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(de, x[t], dg)
                du[:, : 2 * n] += h.T @ dg[:, : 2 * n]
                du[:, 2 * n :] += (r * h).T @ dc
                back = dh * (1 - z) + drh * r + dg[:, : 2 * n] @ u[:, : 2 * n].T
            out[f"E{d}"], out[f"U{d}"] = de, du
        return loss, out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 0) -> None:
        """Adam over random batches of windows; x (windows, steps). A batch draws labels evenly, then windows of them."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.argsort(y, kind="stable")
        labels, first, many = np.unique(y[order], return_index=True, return_counts=True)
        for k in range(1, steps + 1):
            drawn = rng.integers(0, len(labels), BATCH)
            rows = order[first[drawn] + (rng.random(BATCH) * many[drawn]).astype(np.int64)]
            _, g = self.gradients(np.ascontiguousarray(x[rows].T), y[rows], np.ascontiguousarray(weight[rows].T))
            rate = RATE * (1 - (k - 1) / steps) + 1e-4
            for name, grad in g.items():
                m[name] += 0.1 * (grad - m[name])
                v2[name] += 0.01 * (grad * grad - v2[name])
                self.p[name] -= (rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v2[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes that may belong to letters: A-Z, a-z and all of multi-byte signs."""
    low = raw | 0x20
    return ((low >= 97) & (low <= 122)) | (raw >= 128)


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text number): all bytes of all texts in windows, the last of each filled up."""
    at, raw = utf8(column)
    size = np.diff(at)
    many = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), many)
    first = np.cumsum(many) - many
    start = at[text] + (np.arange(len(text)) - first[text]) * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    inside = place < at[text + 1][:, None]
    own = raw[np.minimum(place, max(len(raw) - 1, 0))].astype(np.int16) if len(raw) else np.int16(0)
    cut = np.where(inside, own, np.int16(256))
    return cut.astype(np.int16), text


def share_out(counts: dict[str, int], sample: int) -> int:
    """The most that any language may send so that all of them send ``sample`` at most, but :data:`LEAST` at least."""
    left, most = sample, max(counts.values(), default=0)
    for k, n in enumerate(sorted(counts.values())):
        if n * (len(counts) - k) > left:
            most = left // (len(counts) - k)
            break
        left -= n
    return max(most, LEAST)


def chosen(labelled: DataFrame, sample: int = SAMPLE, seed: int = 0) -> list:
    """Rows (lang, key, text): of every language the whole texts with the smallest hashes, equal texts once."""
    keyed = labelled.where("lang is not null and length(text) > 0").select("lang", F.xxhash64("text", F.lit(seed)).alias("key"), "text")
    keys = materialize(keyed.select("lang", "key").distinct(), "labelled")
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    if not counts:
        return []
    most = share_out(counts, sample)
    # Hashes are even, so a bound on them leaves about as many as are wanted; half more and some are let through.
    bounds = [(g, min((1 << 63) - 1, int((most * 1.5 + 50) / n * (1 << 64)) - (1 << 63))) for g, n in counts.items()]
    bound = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    sent, pairs = dict.fromkeys(counts, 0), []
    for r in sorted(keys.join(bound, "lang").where("key <= bound").select("lang", "key").collect(), key=lambda r: (r["key"], r["lang"])):
        sent[r["lang"]] += 1
        if sent[r["lang"]] <= most:
            pairs.append((r["lang"], r["key"]))
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(pairs, "lang string, key long"))  # about ``sample`` rows
    own = keyed.join(wanted, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    return sorted(own.collect(), key=lambda r: (r["key"], r["lang"]))


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 0) -> tuple[BiGru | None, list[str]]:
    """A network from ``labelled(text, lang)`` that knows every language there, from all windows of the :func:`chosen` texts."""
    rows = chosen(labelled, sample, seed)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None, []
    x, text = windows(pa.array([r["text"] for r in rows], pa.large_string()))
    y = np.array([langs.index(r["lang"]) for r in rows])[text]
    weight = _letters(np.minimum(x, 255).astype(np.uint8)) & (x < 256)
    net = BiGru(len(langs), seed=seed)
    net.fit(x, y, weight.astype(np.float32), seed=seed)
    return net, langs


def pooled(net: BiGru, column: pa.Array, classes: int, block: int = 4096) -> np.ndarray:
    """Mean probability of each class over the letter positions of each text."""
    cut, text = windows(column)
    sums = np.zeros((len(column), classes))
    counts = np.zeros(len(column))
    for k in range(0, len(cut), block):
        own, rows = cut[k : k + block], text[k : k + block]
        use = (_letters(np.minimum(own, 255).astype(np.uint8)) & (own < 256)).astype(np.float32)
        p = net.label(np.ascontiguousarray(own.T))
        total = np.einsum("trc,rt->rc", p, use)
        for c in range(classes):
            sums[:, c] += np.bincount(rows, total[:, c], len(column))
        counts += np.bincount(rows, use.sum(1), len(column))
    return sums / np.maximum(counts, 1)[:, None]


def predict(docs: DataFrame, net: BiGru | None, langs: list[str]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()], bool)
            if net is None:
                found[:] = False
            p = pooled(net, batch.column("text"), len(langs)) if net is not None else np.zeros((len(found), 1))
            best = p.argmax(1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array([langs[b] if f else "und" for b, f in zip(best, found, strict=True)], pa.string()),
                    "score": pa.array(np.where(found, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)),
                }
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is kept from training: CRC-32 of the id as text divisible by FOLDS; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))

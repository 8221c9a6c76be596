import re

import numpy as np
import pyarrow as pa

from aspectra.llm import words

TEXTS = ["", "a", " \t a  B\nc ", "Ünï ünï", "x" * 5000, "one two three " * 900, "\x0b\x0c\r", "END", "end"]


def split(t):
    return [w for w in re.split("[ \t-\r]+", t) if w]


def test_equal_words_equal_hashes(monkeypatch):
    for block in (words.BLOCK, 64):
        monkeypatch.setattr(words, "BLOCK", block)
        h, at = words.word_hashes(pa.array(TEXTS), fold=True)
        seen = {}
        for k, t in enumerate(TEXTS):
            own = h[at[k] : at[k + 1]].tolist()
            low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in split(t)]
            assert len(own) == len(low)
            for w, x in zip(low, own, strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
        full = words.text_words(pa.array(TEXTS))
        assert full.hashes.tolist() == h.tolist() and full.size.tolist() == [len(w.encode()) for t in TEXTS for w in split(t)]


def test_shingles():
    h, first = words.shingle_hashes(pa.array(TEXTS), 3, fold=False)
    assert np.diff(first).tolist() == [max(0, n - 2) if n >= 3 else min(n, 1) for n in (len(split(t)) for t in TEXTS)]
    sets = list(words.distinct_sets(h, first))
    assert [len(s) for s in sets] == [len({tuple(split(t)[i : i + 3]) for i in range(max(1, len(split(t)) - 2))}) if split(t) else 0 for t in TEXTS]


def test_slices_and_packing():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS), "n": pa.array(range(len(TEXTS)))})
    got = [n for b in words.sliced(iter([batch]), most=100, rows=2) for n in b.column("n").to_pylist()]
    assert got == list(range(len(TEXTS)))
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64))
    assert (words.unpacked(words.packed(x)) == x).all() and not len(words.unpacked(words.packed(x[:0])))

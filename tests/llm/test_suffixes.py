import hashlib
import random

import numpy as np

from aspectra.llm import q_suffixes, suffixes


def brute(rows):
    least = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            least[s] = min(d, least.get(s, d))
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        own = gone[:-1]
        runs = int((own & ~np.concatenate([[False], own[:-1]])).sum()) if len(raw) else 0
        out.append((d, len(raw), int(own.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~own])).hexdigest()))
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.without_repeats(df).collect())


def test_op4(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in q_suffixes.op4_suffix_dedup(spark, sf).collect())
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_small_alphabet(spark):
    """Periodic and shared stretches, cuts around 50 bytes, multi-byte signs."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab") for _ in range(n)) for n in (30, 49, 50, 51, 60, 75, 120, 300)] + ["ab" * 60, "a" * 130, "é" * 40, "x€" * 30]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(4) :] + rng.choice(["", "|", "zz"]) for _ in range(rng.randrange(1, 5)))) for i in range(70)]
    assert run(spark, rows) == brute(rows)


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 200)
    monkeypatch.setattr(suffixes, "BLOCK", 8)
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    rows = [(1, None), (2, ""), (3, "short"), (4, text), (5, text[100:149]), (6, text[100:150]), (7, text[300:] + text[:300]), (8, text), (9, text), (9, text)]
    assert run(spark, rows, 1) == brute(rows)
    assert run(spark, rows, 5) == brute(rows)
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_and_missing_ids(spark):
    """Rows that share an id or have none: each loses what smaller ids have, and nothing to rows of its own id."""
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    other = "".join(chr(65 + (i * i + i // 5) % 26) for i in range(400))
    rows = [(1, text), (2, "x" + text[100:220] + "y"), (2, other), (2, other), (None, other[:120]), (None, text), (None, "new " + other[200:300]), (None, None), (-5, text[500:600])]
    df = spark.createDataFrame([(*r, "kept", k) for k, r in enumerate(rows)], "doc_id long, text string, row string, rank int").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.without_repeats(df).collect())
    last = 1 << 62
    want = [(d == last, 0 if d == last else d, *rest) for d, *rest in brute([(last if d is None else d, t) for d, t in rows])]
    assert got == sorted(want)


def test_ranks_beyond_16_bits():
    """One anchor with more than 65,536 contexts, and a column that few of them reach."""
    rng = np.random.default_rng(8)
    n, few = 140_000, np.arange(0, 140_000, 35)
    text = np.full((n, suffixes.WIDE), ord("x"), np.uint8)
    text[:, 52:] = rng.integers(97, 123, (n, suffixes.WIDE - 52))
    text[:, 2] = rng.choice([ord("b"), ord("c")], n)
    first = np.full(n, suffixes.SPAN - 1)
    first[few] = 2
    last = first.copy()
    doc = rng.permutation(n)
    got = {c: set(rows.tolist()) for c, rows in suffixes.repeats(text, np.zeros(n, np.int64), first, last, doc)}
    for c in (2, suffixes.SPAN - 1):
        rows = np.flatnonzero(first == c)
        least = {}
        for r in rows.tolist():
            s = text[r, c : c + suffixes.LENGTH].tobytes()
            least[s] = min(int(doc[r]), least.get(s, n))
        want = {r for r in rows.tolist() if least[text[r, c : c + suffixes.LENGTH].tobytes()] < doc[r]}
        assert got.get(c, set()) == want
    assert len(got[2]) == len(few) - 2

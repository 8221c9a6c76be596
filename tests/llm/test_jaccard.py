import random
import re

import numpy as np
import pytest

from aspectra.llm import jaccard, q_jaccard
from aspectra.llm.spark import components


def sets_of(rows, width):
    out = {}
    for d, text in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        out[d] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])
    return out


def brute(rows, width, num, den):
    sets = sets_of(rows, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def check(spark, rows, width, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(df, width, num, den).collect())
    assert got == brute(rows, width, num, den)
    return got


def test_op9(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in q_jaccard.op9_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_chains(spark, width, num):
    """Chains of edits, sizes from 1 to 400 words, subsets and near misses."""
    rng = random.Random(num)
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60, 90, 150, 400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, size // rng.choice([20, 40, 60]))):
                k = rng.randrange(len(words))
                words[k : k + rng.choice([0, 1])] = [f"w{rng.randrange(10**6)}"] * rng.choice([0, 1]) or [words[k]]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = check(spark, rows, width, num, 100)
    assert 20 < len({c for _, _, c in got}) < len(rows)


def test_odd(spark):
    check(spark, [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a\nB"), (6, "x " * 20_000), (7, "x  " * 9)], 3, 90, 100)
    one = spark.createDataFrame([(1, "a b c d e f", "z"), (1, "a b c d e f", "z"), (2, None, "z"), (3, None, "z")], "doc_id long, text string, label string")
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(one).collect()) == [1, 2, 3]
    assert jaccard.one_of_each(one.limit(0)).columns == one.columns
    assert jaccard.link_components(one.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.link_components(none).collect()))
    assert got == [(0, 0, 0), (0, 2, 0), (0, 2, 0), (4, 2, 4)]


def test_one_of_each_by_row(spark):
    """Rows without doc_id and rows that share one go only where their texts are equal or linked."""
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    a, b, c, d, e = map(words, "abcde")
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d + " more"), (8, c + " more"), (9, e), (None, e + " more"), (None, None), (5, None), (5, ""), (6, d)]
    df = spark.createDataFrame([(i, t, "z", f"{i}", 0.5) for i, t in rows], "doc_id long, text string, label string, _row string, _comp double").repartition(3)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns and all((r["label"], r["_row"], r["_comp"]) == ("z", f"{r['doc_id']}", 0.5) for r in got.collect())
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
    assert got == sorted([(0, a), (0, b), (0, ""), (5, ""), (6, d), (7, c), (9, e)])
    plain = spark.createDataFrame([(2, a), (1, b), (3, a + " more")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(plain).collect()) == [1, 2]


@pytest.mark.parametrize("large", [2, 12])
def test_blocks(spark, monkeypatch, large):
    """Tiles that take several blocks give the same links."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "LARGE_TILE", large)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 3, 90, 100)


def test_links_between_bound():
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(150, 300), replace=False)) for _ in range(40)]
    got = {frozenset(p) for p in jaccard.links_between(sets, list(range(40)), None, 60, 100)}
    root = list(range(40))
    for a, b in got:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    for i in range(40):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j], 60, 100):
                assert root[i] == root[j]


def test_members_that_collide(spark):
    """Two sets of members with one least id, one number and, as it used to be summed, one 32-bit hash sum stay two."""
    from pyspark.sql import functions as F

    seen, pair = {}, None
    rows = spark.range(1, 400_000).select(F.abs(F.xxhash64("id")).alias("id")).select("id", F.hash("id").alias("h")).collect()
    for r in rows:
        if r["h"] in seen:
            pair = (seen[r["h"]], r["id"])
            break
        seen[r["h"]] = r["id"]
    assert pair, "some two of so many ids share 32 bits"
    df = spark.createDataFrame([(1, 0), (1, pair[0]), (2, 0), (2, pair[1]), (3, 0), (3, pair[1])], "tile long, id long")
    names = {r["tile"]: tuple(r[c] for c in jaccard.MEMBERS) for r in df.groupBy("tile").agg(*jaccard._members("id")).collect()}
    assert names[1] != names[2] and names[2] == names[3]


@pytest.mark.parametrize("edges_a_task", [1 << 20, 40])
def test_components_by_task(spark, monkeypatch, edges_a_task):
    """A chain, a star and a few pairs, joined up in one task or in many that each see some edges."""
    from aspectra.llm import spark as shared

    monkeypatch.setattr(shared, "EDGES", edges_a_task)
    rng = random.Random(6)
    ids = rng.sample(range(10**6), 700)
    edges = list(zip(ids[:300], ids[1:300])) + [(ids[300], k) for k in ids[301:600]] + list(zip(ids[600::2], ids[601::2])) + [(5, 5)]
    rng.shuffle(edges)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = {k: min(g) for g in (ids[:300], ids[300:600], *[ids[i : i + 2] for i in range(600, 700, 2)]) for k in g}
    assert got == want and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    ids = list(range(0, 400))
    rng.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[200], k) for k in ids[201:]]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in ids[:200]} == {min(ids[:200])} and {got[k] for k in ids[200:]} == {min(ids[200:])}

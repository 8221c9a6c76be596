import numpy as np
from pyspark.sql import functions as F

from aspectra.llm import mtree


def brute(ids, x, k):
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        own = [(-int(s), int(v)) for s, v in zip(x @ x[q], ids, strict=True) if v != ids[q]]
        out += [(int(ids[q]), r + 1, v, -s) for r, (s, v) in enumerate(sorted(own)[:k])]
    return sorted(out)


def test_ties_and_copies(spark, monkeypatch):
    """Clustered vectors of few values, a third of them equal, in small shards and pages."""
    monkeypatch.setattr(mtree, "SHARD", 300)
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (1500, 6)) + 20 * rng.integers(0, 2, (1500, 6))
    x[::3] = x[0]
    ids = np.arange(1500) * 5
    df = spark.createDataFrame([(int(i), [int(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, x array<long>")
    got = sorted(tuple(r) for r in mtree.search(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute(ids, x.astype(float), 5)


def test_bound_goes_along(spark, monkeypatch):
    """Shards answer queries from elsewhere with what reaches the score of their own neighbourhood, and no more."""
    monkeypatch.setattr(mtree, "SHARD", 100)
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 20, (2000, 5)) + 400 * rng.normal(0, 1, (12, 5))[rng.integers(0, 12, 2000)]).astype(int)
    df = spark.createDataFrame([(i, [int(v) for v in row], i * 2) for i, row in enumerate(x)], "vec_id long, x array<long>, rank long").repartition(3)
    got = sorted(tuple(r) for r in mtree.search(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute(np.arange(2000), x.astype(float), 5)


def test_large_numbers(spark):
    """Products beyond 2^53 are compared as whole numbers."""
    big = 1 << 30
    rows = [(0, [big + 1, 3]), (1, [big, 2]), (2, [big, 3]), (3, [big, 1]), (50, [3, -big])]
    v = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = sorted(tuple(r) for r in mtree.search(v, v.where("vec_id % 50 = 0")).collect())
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    x = dict(rows)
    want = []
    for q in (0, 50):
        best = sorted((-dot(x[q], x[v]), v) for v in x if v != q)
        want += [(q, k, v, -s) for k, (s, v) in enumerate(best, 1)]
    assert got == want


def test_levels():
    """A tree of many pages has nodes above nodes, and covers all that is below."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 100, (9000, 3)))
    tree = mtree.Tree(np.arange(9000), x, np.zeros(9000, int), float((x * x).sum(1).max()))
    depth, level = 0, [tree.root]
    while level[0].children is not None:
        assert all(len(n.children) <= mtree.FANOUT and (n.far + [c.radius for c in n.children] <= n.radius + 1e-6).all() for n in level)
        depth, level = depth + 1, [c for n in level for c in n.children]
    assert depth >= 2 and sum(len(n.ids) for n in level) == 9000
    for q in x[:20]:
        want = sorted((-int(s), i) for i, s in enumerate(x @ q))[:5]
        assert sorted((-s, i) for s, i in tree.search(-1, q, 5)) == want


def test_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 3, (4000, 4)) + 200 * np.eye(4)[rng.integers(0, 4, 4000)])
    tree = mtree.Tree(np.arange(4000), x, x.argmax(1), float((x * x).sum(1).max()))
    tree.search(-1, x[0], 5)
    assert tree.counted < 2500


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5]), (6, []), (50, [-1.0, 2.0]), (0, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(mtree.usable(F.col("embedding")))
    v = df.select("vec_id", mtree.whole(F.col("embedding")).alias("x"))
    got = sorted(tuple(r) for r in mtree.search(v, v.where("vec_id % 50 = 0")).collect())
    assert got[0] == (0, 1, 5, 256 * 128) and {r[0] for r in got} == {0, 50} and len(got) == 7
    assert mtree.search(v.limit(0), v.limit(0)).count() == 0

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aspectra.llm import mixing, q_resampling, resampling

ODD = "doc_id long, text string, lang string, source string, rate string"
ROWS = [(1, None, None, None, "a"), (2, "", "en", "s", None), (None, "a b", "en", "s", "a"), (3, "x " * 30_000, "xx", "s", "a"), (3, "x " * 30_000, "xx", "s", "a")]


FULL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def plain_features(text):
    """Buckets of a text's features, word by word in plain Python."""
    base, words = 0x9E3779B97F4A7C15, []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
        h = mixed(sum(mixed((b + 1) * base & FULL) * pow(base, k, 1 << 64) for k, b in enumerate(low)) & FULL)
        capitals = sum(65 <= b <= 90 for b in w)
        symbol = 0 if 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or w[-1] >= 97 else w[-1]
        again = bool(words) and words[-1][0] == h
        words.append((h, mixed((((min(capitals, 2) * 2 + again) * 256 + symbol) * 8 + min(len(w) // 4, 7)) + (1 << 32))))
    out = [x for w in words for x in w]
    for (h, a), (g, b) in zip(words, words[1:]):
        out += [mixed((h * 0xD6E8FEB86659FD93 + g) & FULL), mixed((a * 0xA0761D6478BD642F + b) & FULL)]
    return [x & (resampling.BUCKETS - 1) for x in out]


def plain_gumbel(doc_id, seed=0):
    u = ((mixed((doc_id + mixed(seed)) & FULL) >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def test_features_against_plain_python():
    texts = ["", "one", "Two two TWO, two", "é Ünï {x} 12 a_b [q]", "x" * 40 + " \t\r\n y\x0b z!", "AbC. AbC. abc."]
    own, text = resampling.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert sorted(own[text == k].tolist()) == sorted(plain_features(t)), t


def test_op2(spark, sf):
    """The whole result from features, models and noise made anew in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    good = set(labels.doc_id[(labels.quality == 1) & (labels.toxic == 0)])
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    found = {d: plain_features(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    for d, own in found.items():
        np.add.at(raw, own, 1)
        if d in good:
            np.add.at(target, own, 1)
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum())
    mean = {d: ratios[own].sum() / (len(own) + resampling.PRIOR) if own else 0.0 for d, own in found.items()}
    draw = {d: round((resampling.SHARPNESS * m + plain_gumbel(d)) * resampling.SCALE) for d, m in mean.items()}
    k = sum(m >= resampling.LEAST for m in mean.values())
    want = set(sorted(draw, key=draw.get, reverse=True)[:k])
    got = q_resampling.op2_importance_resampling(spark, sf).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == k
    assert all(abs(r["draw"] - draw[r["doc_id"]]) <= 2 and abs(r["log_ratio"] - mean[r["doc_id"]]) < 1e-9 for r in got)
    bad = set(labels.doc_id[labels.quality == 0])
    assert good <= want and not bad & want


def test_kth(spark):
    values = [5, 5, 5, -3, 9, 10**15, -(10**15), 0]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, 9):
        value, ties = resampling.kth_largest(df, "v", k)
        order = sorted(values, reverse=True)
        assert value == order[k - 1] and ties == k - sum(v > value for v in values)


def test_resample_odd(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resample(df, none).count() == 5
    assert resampling.resample(df, none, k=2).count() == 2
    assert resampling.filter_documents(df, none).columns == df.columns and resampling.filter_documents(df, none).count() == 5
    assert resampling.filter_documents(df.limit(0), none).count() == 0
    rows = [(1 << 60, "good words here " * 9, "x", 1), ((1 << 60) + 1, "@@ ## $$ " * 9, "y", 2), (None, "@@ ## $$ " * 9, "z", 3), (-1, "good words here " * 9, "w", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _id string, _hash long")
    some = spark.createDataFrame([(1 << 60, 1, 0)], "doc_id long, quality int, toxic int")
    scored = resampling.score(odd, resampling.log_ratios(odd, resampling.good_ids(some))).collect()
    mean = {r["doc_id"]: r["log_ratio"] for r in scored}
    assert min(mean[1 << 60], mean[-1]) > max(mean[None], mean[(1 << 60) + 1])
    monkeypatch.setattr(resampling, "LEAST", mean[-1])
    got = sorted(((r["doc_id"] or 0, r["_id"], r["_hash"]) for r in resampling.filter_documents(odd, some).collect()))
    assert got == [(-1, "w", 4), (1 << 60, "x", 1)]
    assert resampling.resample(df.limit(0), none).count() == 0


def test_mix_odd(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 7.5, "mine") for r in ROWS], ODD + ", drawn double, _tokens string")
    for cells in (mixing.BROADCAST_CELLS, 0):  # rates by broadcast, then by salted cells
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
        mixed, rate, drawn = mixing.mix_described(*mixing.described(df))
        got = mixed.collect()
        assert len(got) == 5 and all(0 <= r[rate] <= 1 and r["drawn"] == 7.5 and r["_tokens"] == "mine" for r in got)
        assert sorted(str(r["rate"]) for r in got) == sorted(str(r[4]) for r in ROWS)
        assert mixing.sample(df, 1.0).columns == df.columns
        assert sorted(map(str, mixing.sample(df, 1.0).collect())) == sorted(map(str, df.collect()))
    assert mixing.sample(df.limit(0)).count() == 0


def cells_of(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own, names = mixing.described(docs)
    return own.groupBy(*[F.col(c).alias(m) for c, m in zip(names, mixing.MARGINS)]).agg(F.sum(names[3]).alias("n"))


def test_margins(spark):
    """At the settings of the query the expected tokens have the target margins."""
    fitted = mixing.rates(cells_of(spark))
    pdf, report = fitted.toPandas(), mixing.residual(fitted)
    assert pdf.rate.between(0, 1).all() and (pdf.rate == 1).any()
    assert np.abs(report.target - report.reached).max() < 1e-6, report
    assert abs((pdf.rate * pdf.n).sum() / pdf.n.sum() - mixing.BUDGET) < 1e-6
    by_lang = report[report.margin == "lang"].set_index("value")
    room = pdf.groupby("lang").n.sum() / pdf.n.sum() / mixing.BUDGET
    for k, v in mixing.LANG_SHARES.items():
        assert by_lang.reached[k] > v - 1e-6 or abs(by_lang.reached[k] - room[k]) < 1e-6


def test_fit_of_many_cells(spark, monkeypatch):
    """The DataFrame fit takes the same steps as the numpy fit."""
    cells = cells_of(spark)
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    want = mixing.rates(cells).toPandas()
    monkeypatch.setattr(mixing, "MOST_CELLS", 0)
    got = mixing.rates(cells).toPandas()
    both = want.merge(got, on=[*mixing.MARGINS, "n"])
    assert len(both) == len(want) == len(got) and np.abs(both.rate_x - both.rate_y).max() <= 2e-7


def test_targets_beyond_reach():
    """A value keeps what it has and the others share the rest; margins that cannot be met together end at the bound."""
    n = np.array([10.0, 100, 1000])
    assert np.allclose(mixing.reachable(n, np.array([0.5, 0.25, 0.25]), 555), [10, 100, 445])
    u, missed = mixing.raked(np.array([10.0, 90, 90, 10]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([30.0, 70]), np.array([75.0, 25])], 0.5)
    w = np.minimum(1, u) * [10, 90, 90, 10]
    assert missed < 1e-12 and np.allclose([w[0] + w[2], w[0] + w[1]], [75, 30])
    u, missed = mixing.raked(np.array([100.0, 100]), [np.array([0, 1]), np.array([0, 1])], [np.array([90.0, 10]), np.array([10.0, 90])], 0.5)
    assert missed > 0.1 and np.isfinite(u).all()

"""Models and queries without SQL against plain numpy and re over whole tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.functions import text as T
from aspectra.operators import models, ranks
from aspectra.plans import catalog
from aspectra.plans.quality import words


def test_normalize_text(spark, sf):
    """The query's whole result against re."""
    sign, space = r"[!-/:-@\[-`{-~]", r"[\s\x1c-\x1f\x85]"
    for r in catalog.queries()["normalize_text"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        x = re.sub("[\U0001f1e6-\U0001f1ff\U0001f300-\U0001faff☀-➿️‍]+", " ", (r["text"] or "").lower())
        x = re.sub(r"([a-z]+?)\1+", r"\1", x)
        x = re.sub(f"{sign}*({sign})", r" \1 ", x)
        x = re.sub(f"^({sign}|{space})+|({sign}|{space})+$", "", x)
        assert r["normalized"] == re.sub(f"{space}+", " ", x), r["doc_id"]


def test_nb_predict(spark, sf):
    """Multinomial naive Bayes from counts of the training folds alone."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = [(r["doc_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["doc_id"] in labels]
    fold = lambda d: (d * 7919 + 104729) % 1000003 % 5
    train = [(labels[d], ws) for d, ws in docs if fold(d)]
    seen = Counter(w for _, ws in train for w in set(ws))
    vocabulary = {w for w, n in seen.items() if n >= 2}
    counts, size = defaultdict(Counter), Counter()
    for label, ws in train:
        size[label] += 1
        counts[label].update(w for w in ws if w in vocabulary)

    def score(label, ws):
        total = sum(counts[label].values())
        logs = sum(np.log((counts[label][w] + 1) / (total + len(vocabulary))) for w in ws if w in vocabulary)
        return np.log((size[label] + 1) / (len(train) + len(size))) + logs

    got = {r["doc_id"]: r["prediction"] for r in catalog.queries()["nb_predict"](spark, sf).collect()}
    held = {d: ws for d, ws in docs if not fold(d)}
    assert got.keys() == held.keys()
    for d, ws in held.items():
        s = {label: score(label, ws) for label in size}
        if len(s) < 2 or abs(s[0] - s[1]) > 1e-6:
            assert got[d] == max(s, key=s.get), d


def test_viterbi_tags(spark, sf):
    """Counts, smoothing and paths of the tagger from the table in plain Python."""
    sents = defaultdict(list)
    for r in words(spark, sf).orderBy("sent", "pos").collect():
        sents[r["sent"]].append((r["word"].lower(), r["tag"]))
    tags = sorted({t for s in sents.values() for _, t in s})
    n, alpha = len(tags), 0.1
    place = {t: k for k, t in enumerate(tags)}
    start, move, total = np.full(n, alpha), np.full((n, n), alpha), np.zeros(n)
    seen = defaultdict(lambda: np.zeros(n))
    for s in sents.values():
        start[place[s[0][1]]] += 1
        for w, t in s:
            seen[w][place[t]] += 1
            total[place[t]] += 1
        for (_, a), (_, b) in zip(s, s[1:]):
            move[place[a], place[b]] += 1
    log_start, log_move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
    got = {(r["sent"], r["pos"]): r["predicted"] for r in catalog.queries()["viterbi_tags"](spark, sf).collect()}
    assert len(got) == sum(map(len, sents.values()))
    for name, s in sents.items():
        logs = np.log(np.array([(seen[w] + alpha) / (total + alpha * len(seen)) for w, _ in s]))
        path = [place[got[name, k]] for k in range(len(s))]
        value = lambda p: log_start[p[0]] + logs[np.arange(len(p)), p].sum() + log_move[p[:-1], p[1:]].sum()  # noqa: B023,E731
        assert value(np.array(path)) >= value(np.array(models.viterbi(log_start, log_move, logs))) - 1e-9


def test_svd_features(spark, sf):
    """Features reproduce the best rank-10 inner products of the counts."""
    docs = {r["doc_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["features"] for r in catalog.queries()["svd_features"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    total, df = Counter(), Counter()
    for ws in docs.values():
        total.update(ws)
        df.update(set(ws))
    counts = sorted((n for w, n in total.items() if df[w] >= 2), reverse=True)
    least = counts[299] if len(counts) > 299 else 0
    ids = sorted(docs)
    features = np.array([got[d] for d in ids])
    sure = [w for w, n in total.items() if df[w] >= 2 and n > least]  # which of those with equal counts are in is open
    x = np.array([[Counter(docs[d])[w] for w in sure] for d in ids], float)
    singular = np.linalg.svd(x, compute_uv=False)[:10]
    ours = np.linalg.norm(features, axis=0)
    assert (np.diff(ours) <= 1e-6).all() and np.allclose(ours[:3], singular[:3], rtol=0.02)
    again = {r["doc_id"]: r["features"] for r in catalog.queries()["svd_features"](spark, sf).collect()}
    assert np.allclose([again[d] for d in ids], features)


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_ranks(spark, keys):
    """Ranks of numbers and strings with ties, a hot value, nulls in the group and no rows."""
    rows = [(i, "a" if i % 3 else None, float(i * 37 % 101) if i % 4 else 7.0, f"w{i * 37 % 101}é") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, v double, s string").where("g IS NOT NULL")
    for value in ("v", "s"):
        got = {r["i"]: r["k"] for r in ranks.running(df, value, "k", keys, ("i",)).collect()}
        key = lambda r: (r[2] if value == "v" else r[3].encode(), r[0])  # noqa: B023,E731
        assert got == {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[1]), key=key), 1)}
    assert ranks.running(df.limit(0), "v", "k", keys).count() == 0


def test_pseudo_words(spark):
    from aspectra.functions import tokens as K

    df = spark.createDataFrame([(w,) for w in ("12", "HTTP", "Paris", "running", "a@b.co", "x-y", "plain")], "w string")
    assert [r[0] for r in df.select(K.pseudo_class(F.col("w"))).collect()] == ["NUM", "ALLCAPS", "CAP", "SUFFIX_ING", "EMAIL", "HYPHEN", "WORD"]
    assert T.segment(F.lit("a")) is not None

"""Scalar functions against plain Python on edge cases; operators on small fixtures."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aspectra.functions import fields
from aspectra.functions import sentiment as S
from aspectra.functions import text as T
from aspectra.functions import tokens as K
from aspectra.operators import metrics, models, reviews
from aspectra.plans.scores import LEXICON

TEXTS = [
    None, "", "   ", " x　\u001cy ", "<p>Hi</p>", "<a<b>c>", unicodedata.normalize("NFD", "Chất lượng KÉM"), "Chất lượng KÉM!", "😀 ok 😀", "?!...", "a_b",
    "aaaa hahaha", "x" * 300, "ko OK sp", "line\nline",
]


def run(spark, values, expression, schema="t string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").select("i", expression.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_clean(spark):
    want = [re.sub(r"\s+", " ", re.sub("<[^>]+>", "", (t or "").lower())).strip() for t in TEXTS]
    assert run(spark, TEXTS, T.clean_stream(F.col("t"))) == want
    want = [re.sub(r"[^\w\s]", " ", re.sub("<[^>]+>", "", t or "")).lower().strip() for t in TEXTS]
    assert run(spark, TEXTS, T.clean_punctuation(F.col("t"))) == want


def test_dedup_key(spark):
    want = [None if t is None else re.sub(r"\s+", "", re.sub(r"[^\w\s]", "", t.strip().lower())) for t in TEXTS]
    assert run(spark, TEXTS, T.dedup_key(F.col("t"))) == want


def test_normalize(spark):
    got = run(spark, ["GOOOD!!! very,very", "...end...", "😀hi", None], T.normalize(F.col("t")))
    assert got == ["god ! very , very", "end", "hi", ""]


def test_abbreviations(spark):
    assert run(spark, ["SP này OK", " a  b "], T.expand_abbreviations(F.col("t"))) == ["sản phẩm này tốt", "a bạn"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_fuzzy_dedup_once_is_enough(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    once = reviews.fuzzy_dedup(df, "t", [F.col("i")])
    a = sorted(r["i"] for r in once.collect())
    assert a == sorted(r["i"] for r in reviews.fuzzy_dedup(once, "t", [F.col("i")]).collect())


def test_compat_dedup(spark):
    """Texts of signs only share one key; the older order drops the whole group when its first is blank."""
    df = spark.createDataFrame([(0, " "), (1, "?!"), (2, "!!"), (3, "a")], "i int, t string")
    ids = lambda compat: sorted(r["i"] for r in reviews.fuzzy_dedup(df, "t", [F.col("i")], compat).collect())
    assert ids(False) == [1, 3] and ids(True) == [3]


def test_item_ids(spark):
    urls = ["x-i1-s2", "x-i3.html", "x-i4", "?itemId=5", "/i6?", "/i7", "products/a-b-8.html", "/123456-x", "/654321?", "a999999", "none", "", None]
    assert run(spark, urls, fields.item_id(F.col("t"))) == ["1", "3", "4", "5", "6", "7", "8", "123456", "654321", "999999", "", "", ""]
    assert run(spark, urls, fields.item_id(F.col("t"), "browser")) == ["1", "3", "4"] + [None] * 10


def test_payloads(spark):
    a = S.ASPECTS[0]
    cases = {
        f'{{"{a}": {{"mentioned": true, "sentiments": ["POS", "NEG"]}}}}': (True, ["POS", "NEG"]),
        f'{{"{a}": {{"mentioned": true, "sentiments": []}}}}': (True, ["NEU"]),
        f'{{"{a}": {{"mentioned": false, "sentiments": null}}}}': (False, None),
        f'{{"{a}": 1}}': (True, ["POS"]), f'{{"{a}": -1}}': (True, ["NEG"]), f'{{"{a}": 0}}': (True, ["NEU"]), f'{{"{a}": 2}}': (False, None), f'{{"{a}": 9}}': (True, ["NEU"]),
        f'{{"{a}": "POS"}}': (True, ["POS"]), f'{{"{a}": null}}': (False, None),
    }
    got = run(spark, list(cases), S.parse_payload(F.col("t")))
    assert [(m[a]["mentioned"], m[a]["sentiments"]) for m in got] == list(cases.values())
    assert run(spark, ['{"error": "x"}', "junk", "", None], S.parse_payload(F.col("t"))) == [None] * 4


def test_codes_there_and_back(spark):
    got = run(spark, [1, -1, 0, 2], S.to_legacy(S.legacy_cell(F.col("t"))), "t int")
    assert got == [1, -1, 0, 2]


def test_scorecard_edges(spark):
    a, b = S.ASPECTS[:2]
    cell = lambda *labels: {"mentioned": True, "sentiments": list(labels)}
    rows = [("p", {a: cell("POS", "NEG")}), ("p", {a: cell("POS")}), ("p", {b: {"mentioned": False, "sentiments": None}}), ("q", None)]
    df = spark.createDataFrame(rows, f"product string, m {S.TYPED}")
    got = {(r["product"], r["aspect"]): r for r in reviews.scorecard(df, "m", ["product"]).collect()}
    assert len(got) == 18
    r = got["p", a]
    assert (r["score"], r["review_count"], r["pct_pos"], r["has_mixed"]) == (66.7, 2, 66.7, True)
    assert (got["q", a]["score"], got["q", a]["review_count"], got["q", a]["pct_pos"]) == (50.0, 0, None)


@pytest.mark.parametrize("n,low,high", [(100, 0, 300), (100, 12, 300), (3, 12, 300), (1000, 90, 20)])
def test_balanced(spark, n, low, high):
    rows = [(i, 1 + i % 3) for i in range(low)] + [(1000 + i, 4 + i % 2) for i in range(high)]
    got = reviews.balanced_sample(spark.createDataFrame(rows, "i int, stars int"), "stars", [F.col("i")], n).collect()
    lows = sum(r["stars"] <= 3 for r in got)
    assert len(got) <= n and len({r["i"] for r in got}) == len(got)
    assert len(got) == min(n, high) if not low else lows == min(low, n) and len(got) - lows <= lows


def test_nearest_rank(spark):
    for values in ([5.0], [1.0, 2.0], [float(v) for v in range(21)], [1.0] * 9 + [7.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        r = metrics.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}).first()
        order = sorted(values)
        assert (r["p50"], r["p95"]) == tuple(order[round((len(order) - 1) * p)] for p in (0.5, 0.95))


def test_word_features(spark):
    words = ["Hello", "HTTP", "it's", "3,000", "a@b.co", "12/3/2020", "20th", "50%", "$5", "www.x.y", "-", "x-y", "iPhone", ""]
    want = ["PROPER", "PROPER", "APOSTROPHE", "CARDINAL", "EMAIL", "DATE", "ORDINAL", "PERCENT", "CURRENCY", "URL", "HYPHEN", "HYPHEN", "WORD", "WORD"]
    assert run(spark, words, K.token_class(F.col("t"))) == want
    assert run(spark, ["Hello12!", "aaBB"], K.short_shape(F.col("t"))) == ["Xxd.", "xX"]
    assert run(spark, ["ABC", "abc", "Abc", "aBc", "ABc", ""], K.case_pattern(F.col("t"))) == ["ALL_UPPER", "ALL_LOWER", "TITLE_CASE", "MIXED_CASE", "FIRST_UPPER", "EMPTY"]


def test_scorer_failure_keeps_rows(spark):
    class Broken:
        aspects = ("a",)

        def predict(self, texts):
            raise RuntimeError("down")

    df = spark.createDataFrame([("x",), (None,)], "t string")
    got = [r["m"] for r in df.select(models.scored_by(Broken, F.col("t")).alias("m")).collect()]
    assert [(m["codes"], m["error"]) for m in got] == [({"a": 2}, "RuntimeError: down")] * 2
    keyword = models.scored_by(lambda: models.KeywordScorer(LEXICON), F.col("t"))
    assert len(df.select(keyword.alias("m")).first()["m"]["codes"]) == len(S.ASPECTS)


def test_payloads_of_every_kind(spark):
    """Cells, replies and numbers that tables rarely hold."""
    cells = [("-1", "NEG"), ("0", "NEU"), (None, None), ("nan", None), ("1.0", "POS"), (" [ -1 , 1 ] ", "NEG,POS"), ("2,1", "POS"), ("x", "NEU"), ("0,1", "POS,NEU")]
    assert run(spark, [c for c, _ in cells], F.array_join(S.cell_labels(F.col("t")), ",")) == [w for _, w in cells]
    assert run(spark, ["(1.234)", "12", "(5,000)", "many", "", None], fields.review_count(F.col("t"))) == [1234, 12, 5000, 0, 0, 0]
    assert run(spark, ["12 likes", "(3)", "none", None], fields.first_number(F.col("t"))) == [12, 3, 0, 0]
    assert run(spark, ["Page 1 out of 12", "Page2out of3", "no pages"], fields.found(F.col("t"), fields.PAGE_TOTAL, 2)) == ["12", "3", None]


def test_viterbi_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        start, move, seen = np.log(rng.random(3)), np.log(rng.random((3, 3))), np.log(rng.random((5, 3)))
        total = lambda p: start[p[0]] + sum(move[a, b] for a, b in zip(p, p[1:])) + sum(seen[i, s] for i, s in enumerate(p))  # noqa: B023,E731
        assert models.viterbi(start, move, seen) == list(max(itertools.product(range(3), repeat=5), key=total))

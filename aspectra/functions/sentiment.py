"""Aspect sentiments: scoring by keywords, decoding of every payload, conversion between codes.

The typed form is a map aspect -> struct<mentioned boolean, sentiments array<string>>
with null sentiments for what is not mentioned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The aspects that reviews are scored on, in order.
ASPECTS = (
    "Chất lượng sản phẩm", "Hiệu năng & Trải nghiệm", "Đúng mô tả", "Giá cả & Khuyến mãi", "Vận chuyển",
    "Đóng gói", "Dịch vụ & Thái độ Shop", "Bảo hành & Đổi trả", "Tính xác thực",
)
POLARITIES = ("NEG", "POS", "NEU")
#: Keywords of the plain vote.
POSITIVE = ("tốt", "đẹp", "nhanh", "chất lượng", "hài lòng", "good", "great")
NEGATIVE = ("xấu", "chậm", "kém", "tệ", "thất vọng", "bad", "poor")
TYPED = "map<string,struct<mentioned:boolean,sentiments:array<string>>>"
#: (aspect, polarity or '' for a bare mention, keyword), matched within lower-cased text
Lexicon = tuple[tuple[str, str, str], ...]


def _cell(mentioned: Column, sentiments: Column) -> Column:
    return F.struct(mentioned.alias("mentioned"), F.when(mentioned, sentiments).alias("sentiments"))


def _labels(*chosen: Column) -> Column:
    """Those of NEG, POS, NEU whose condition holds; NEU if none does."""
    found = F.filter(F.array(*[F.when(c, p) for c, p in zip(chosen, POLARITIES, strict=True)]), lambda p: p.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("NEU"))).otherwise(found)


def _cells(has: Callable[[str], Column], lexicon: Lexicon, aspects: tuple[str, ...]) -> Column:
    cells = []
    for a in aspects:
        found = {p: F.lit(False) for p in ("", *POLARITIES)}
        for _, p, word in (x for x in lexicon if x[0] == a):
            found[p] = found[p] | has(word)
        cells.append(_cell(found[""] | found["NEG"] | found["POS"] | found["NEU"], _labels(*[found[p] for p in POLARITIES])))
    return F.map_from_arrays(F.array(*map(F.lit, aspects)), F.array(*cells))


def keyword_scores(text: Column, lexicon: Lexicon, aspects: tuple[str, ...] = ASPECTS) -> Column:
    """The typed map of a text: an aspect is mentioned if one of its keywords is there; a bare mention is neutral."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _cells(lambda word: low.contains(word), lexicon, aspects)


def with_scores(df: DataFrame, text: str, lexicon: Lexicon, into: str, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """``df`` with :func:`keyword_scores` as ``into``: each keyword is looked for once a text, in a projection of its own."""
    words = sorted({w for a, _, w in lexicon if a in aspects})
    flagged = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    flagged = flagged.withColumn("_flags", F.array(*[F.col("_low").contains(w) for w in words])).drop("_low")
    return flagged.withColumn(into, _cells(lambda word: F.get("_flags", F.lit(words.index(word))), lexicon, aspects)).drop("_flags")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def keyword_vote(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    p, n = hits(text, positive), hits(text, negative)
    return F.when(p > n, "POSITIVE").when(n > p, "NEGATIVE").otherwise("NEUTRAL")


def legacy_cell(code: Column) -> Column:
    """1, -1, 0, 2 as a typed cell: 2 is not mentioned, unknown codes are neutral."""
    return _cell(code != 2, _labels(code == -1, code == 1, F.lit(False)))


def to_legacy(cell: Column) -> Column:
    """A typed cell as 1, -1, 0 (mixed or neutral) or 2 (not mentioned)."""
    pos, neg = F.array_contains(cell["sentiments"], "POS"), F.array_contains(cell["sentiments"], "NEG")
    return F.when(~F.coalesce(cell["mentioned"], F.lit(False)), 2).when(pos & neg, 0).when(pos, 1).when(neg, -1).otherwise(0)


def parse_payload(raw: Column) -> Column:
    """A payload in any known shape as the typed map; null if it is none.

    Values are decoded one by one: a whole number is a legacy code, a quoted
    polarity a single label, null or 'null' not mentioned, an object a typed cell.
    """
    text = F.from_json(raw, "map<string,string>")

    def decode(_: Column, v: Column) -> Column:
        known = v.isin(*POLARITIES)
        cell = F.from_json(v, "mentioned boolean, sentiments array<string>")
        full = F.struct(
            F.coalesce(cell["mentioned"], F.lit(False)).alias("mentioned"),
            F.when(cell["mentioned"], F.when(F.coalesce(F.size(cell["sentiments"]), F.lit(0)) <= 0, F.array(F.lit("NEU"))).otherwise(cell["sentiments"])).alias("sentiments"),
        )
        return (
            F.when(v.rlike("^-?[0-9]+$"), legacy_cell(v.try_cast("int")))
            .when(F.coalesce(known, F.lit(False)), _cell(F.lit(True), F.array(v)))
            .when(v.startswith("{"), full)
            .otherwise(_cell(F.lit(False), F.array(F.lit("NEU"))))
        )

    return F.when(F.map_contains_key(text, "error"), F.lit(None)).otherwise(F.transform_values(text, decode))


def parse_reply(reply: Column) -> Column:
    """map<string,string> of a model's reply: the reply itself, else its span from the first { to the last }."""
    span = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(reply, "map<string,string>"), F.from_json(span, "map<string,string>"))


def from_flat(flat: Column, aspects: tuple[str, ...] = ASPECTS) -> Column:
    """aspect -> 'POS' and the like, as the typed map over fixed aspects."""
    one = lambda a: F.try_element_at(flat, a)
    return F.map_from_arrays(
        F.array(*map(F.lit, aspects)),
        F.array(*[_cell(F.coalesce(one(F.lit(a)).isin(*POLARITIES), F.lit(False)), F.array(one(F.lit(a)))) for a in aspects]),
    )


def threshold(mention: Column, logits: Column, least: float = 0.5) -> Column:
    """A typed cell from a mention logit and an array of logits in the order NEG, POS, NEU."""
    p = lambda x: 1 / (1 + F.exp(-x))
    return _cell(p(mention) > least, _labels(*[p(F.get(logits, F.lit(k))) > least for k in range(3)]))


def cell_labels(cell: Column) -> Column:
    """Labels of a cell of the current code (-1, 0, 1, 2, blank, lists, brackets): null if not mentioned."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(cell, F.lit(""))), r"[\[\]]", ""))
    parts = F.transform(F.split(bare, ","), lambda p: F.trim(p))
    codes = F.transform(parts, lambda p: p.try_cast("double").cast("int"))
    has = lambda k: F.exists(codes, lambda c: F.coalesce(c == k, F.lit(False)))
    other = F.exists(codes, lambda c: c.isNull() | ~c.isin(-1, 1, 2))
    return F.when(~bare.isin("", "2", "nan") & ~F.coalesce(F.forall(codes, lambda c: F.coalesce(c == 2, F.lit(False))), F.lit(False)), _labels(has(-1), has(1), other))


def legacy_cell_labels(cell: Column) -> Column:
    """Label of a cell of the legacy code (-1 none, 0 NEG, 1 POS, 2 NEU): null if not mentioned."""
    code = cell.try_cast("double").cast("int")
    return F.when(code == 0, "NEG").when(code == 1, "POS").when(code == 2, "NEU")


def score_of(label: Column) -> Column:
    return F.when(label == "POS", 100).when(label == "NEU", 50).when(label == "NEG", 0)


def display_labels(cell: Column) -> Column:
    """'POS, NEG' for people to read; NEU where nothing is said."""
    return F.when(F.coalesce(F.size(cell["sentiments"]), F.lit(0)) > 0, F.array_join(cell["sentiments"], ", ")).otherwise("NEU")

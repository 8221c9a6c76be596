"""Queries from text to scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import sentiment as S
from aspectra.functions import text as T
from aspectra.operators import ranks
from aspectra.operators import reviews as R

from .registry import query, quoted, table

#: Keywords that the synthetic prose does hold, so that every polarity, tie, mix and gap occurs.
LEXICON: S.Lexicon = (
    (S.ASPECTS[0], "POS", "tion"), (S.ASPECTS[0], "NEG", "ver"), (S.ASPECTS[1], "POS", "her"), (S.ASPECTS[1], "NEU", "ment"),
    (S.ASPECTS[2], "NEG", "ado"), (S.ASPECTS[3], "", "schen"), (S.ASPECTS[4], "NEG", "her"), (S.ASPECTS[4], "POS", "ing"),
    (S.ASPECTS[5], "POS", "eau"), (S.ASPECTS[5], "NEG", "ción"), (S.ASPECTS[6], "", "mente"), (S.ASPECTS[7], "NEU", "keit"),
    (S.ASPECTS[8], "POS", "qqqq"),
)
VOTES = {"positive": ("tion", "her", "eau"), "negative": ("ver", "ado", "ment", "schen")}


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews: product by source, stars from the id, arrival by id."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS review_id", "source AS product_id", "text", "CAST(1 + doc_id % 5 AS INT) AS rating")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_scores(reviews(spark, sf_dir), "text", LEXICON, "cells")


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("codes", F.transform_values("cells", lambda _, c: S.to_legacy(c)))


def _long_sql() -> str:
    """cells(doc_id, source, aspect, m, neg, pos, neu): one row per document and aspect."""
    out = []
    for a in S.ASPECTS:
        any_of = lambda p, a=a: " OR ".join(f"contains(lower(text), {quoted(w)})" for x, q, w in LEXICON if x == a and q == p) or "false"
        out.append(f"SELECT doc_id, source, {quoted(a)} AS aspect, ({any_of('')}) AS bare, ({any_of('NEG')}) AS neg, ({any_of('POS')}) AS pos, ({any_of('NEU')}) AS neu FROM documents")
    return f"""raw AS ({' UNION ALL '.join(out)}),
cells AS (SELECT doc_id, source, aspect, (bare OR neg OR pos OR neu) AS m, CAST(neg AS INT) AS neg, CAST(pos AS INT) AS pos,
  CASE WHEN neu OR (bare AND NOT neg AND NOT pos) THEN 1 ELSE 0 END AS neu FROM raw),
codes AS (SELECT *, CASE WHEN NOT m THEN 2 WHEN pos = 1 AND neg = 1 THEN 0 WHEN pos = 1 THEN 1 WHEN neg = 1 THEN -1 ELSE 0 END AS code FROM cells)"""


LONG = _long_sql()
CARD_SQL = f"""WITH {LONG},
s AS (SELECT source, aspect, count(*) FILTER (m) AS review_count, CAST(sum(neg) AS DOUBLE) AS n, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neu) AS DOUBLE) AS u, bool_or(neg + pos + neu > 1) AS has_mixed
  FROM cells GROUP BY source, aspect)
SELECT source AS product_id, aspect, CASE WHEN n + p + u > 0 THEN round_even((100 * p + 50 * u) / (n + p + u), 1) ELSE 50 END AS score, review_count,
  CASE WHEN n + p + u > 0 THEN round_even(100 * p / (n + p + u), 1) END AS pct_pos, CASE WHEN n + p + u > 0 THEN round_even(100 * n / (n + p + u), 1) END AS pct_neg,
  CASE WHEN n + p + u > 0 THEN round_even(100 * u / (n + p + u), 1) END AS pct_neu, has_mixed FROM s"""


@query("aspect_scorecard", CARD_SQL)
def aspect_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scorecard(scored(spark, sf_dir), "cells", ["product_id"])


@query("aspect_scorecard_nested", f"SELECT product_id, aspect, score, review_count, CAST(count(*) OVER (PARTITION BY product_id) AS INTEGER) AS n_aspects FROM ({CARD_SQL})")
def aspect_scorecard_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = aspect_scorecard(spark, sf_dir).groupBy("product_id").agg(F.collect_list(F.struct("aspect", "score", "review_count")).alias("aspects"))
    return card.select("product_id", F.size("aspects").alias("n_aspects"), F.explode("aspects").alias("a")).select("product_id", "a.*", "n_aspects")


def _plain_sql(default: int) -> str:
    return f"""WITH {LONG}
SELECT source AS product_id, aspect, coalesce(round_even(CAST(sum(CASE code WHEN 1 THEN 100 WHEN 0 THEN 50 WHEN -1 THEN 0 END) AS DOUBLE) / count(CASE WHEN code <> 2 THEN 1 END), 1), {default}) AS score
FROM codes GROUP BY source, aspect"""


@query("aspect_scores_default50", _plain_sql(50))
def aspect_scores_default50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plain_scores(legacy(spark, sf_dir), "codes", ["product_id"])


@query("aspect_scores_default0", _plain_sql(0))
def aspect_scores_default0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plain_scores(legacy(spark, sf_dir), "codes", ["product_id"], default=0.0)


@query(
    "polarity_summary",
    f"WITH {LONG} SELECT source AS product_id, aspect, CAST(sum(pos) AS BIGINT) AS positive, CAST(sum(neg) AS BIGINT) AS negative, CAST(sum(neu) AS BIGINT) AS neutral FROM cells GROUP BY source, aspect",
)
def polarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.polarity_summary(scored(spark, sf_dir), "cells", ["product_id"])


@query(
    "polarity_summary_labels",
    f"""WITH {LONG} SELECT doc_id AS review_id, aspect, CASE WHEN neg + pos + neu = 0 THEN 'NEU' ELSE array_to_string(list_filter([CASE WHEN neg = 1 THEN 'NEG' END, CASE WHEN pos = 1 THEN 'POS' END, CASE WHEN neu = 1 THEN 'NEU' END], lambda x: x IS NOT NULL), ', ') END AS labels FROM cells""",
)
def polarity_summary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scored(spark, sf_dir).select("review_id", F.explode("cells").alias("aspect", "cell"))
    return long.select("review_id", "aspect", S.display_labels(F.col("cell")).alias("labels"))


@query(
    "kpi_overview",
    f"""WITH {LONG} SELECT count(DISTINCT doc_id) AS total_reviews, (CAST(sum(CASE WHEN code <> 2 THEN code END) AS DOUBLE) / count(CASE WHEN code <> 2 THEN 1 END) + 1) * 50 AS avg_sentiment,
  100.0::DOUBLE * count(*) FILTER (code = 1) / greatest(count(CASE WHEN code <> 2 THEN 1 END), 1) AS positive_rate FROM codes""",
)
def kpi_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kpi(legacy(spark, sf_dir), "codes")


@query(
    "review_trend",
    f"""WITH {LONG}, r AS (SELECT doc_id, any_value(source) AS source, coalesce(CAST(sum(CASE WHEN code <> 2 THEN code END) AS DOUBLE) / count(CASE WHEN code <> 2 THEN 1 END), 0) AS mean_sentiment FROM codes GROUP BY doc_id)
SELECT source AS product_id, doc_id AS review_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS seq, mean_sentiment FROM r""",
)
def review_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's reviews are ranked in buckets of ids, so one with a third of all is shared out."""
    said = F.filter(F.map_values("codes"), lambda c: c != 2)
    mean = F.when(F.size(said) > 0, F.aggregate(said, F.lit(0), lambda s, c: s + c) / F.size(said)).otherwise(0.0)
    ids = reviews(spark, sf_dir).select("review_id")
    own = legacy(spark, sf_dir).select("product_id", "review_id", mean.alias("mean_sentiment"))
    ranked = ranks.running(own, "review_id", "k", ("product_id",), bounds=ranks.edges(ids, "review_id", ranks.width(ids)))
    return ranked.select("product_id", "review_id", (F.col("k") - 1).cast("int").alias("seq"), "mean_sentiment")


W = T.SPACE
STRIP = lambda x: f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


@query("clean_stream_text", f"SELECT page_id, {STRIP(f'''regexp_replace(regexp_replace(lower(coalesce(html, '')), '<[^>]+>', '', 'g'), '{W}+', ' ', 'g')''')} AS cleaned FROM pages")
def clean_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_stream(F.col("html")).alias("cleaned"))


@query("clean_punct_text", f"SELECT doc_id, {STRIP(f'''lower(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '{T.SIGN}', ' ', 'g'))''')} AS cleaned FROM documents")
def clean_punct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_punctuation(F.col("text")).alias("cleaned"))


@query("normalize_text", None)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


#: Words of the synthetic prose, so that the table has hits there.
EXPANSIONS = {"the": "T-H-E", "is": "equals", "de": "of the", "und": "and", "que": "which"}


@query(
    "expand_abbrev",
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '{W}+'), lambda w: w <> ''), lambda w: CASE lower(w) """
    + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in EXPANSIONS.items())
    + " ELSE w END), ' ') AS expanded FROM documents",
)
def expand_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.expand_abbreviations(F.col("text"), EXPANSIONS).alias("expanded"))


@query(
    "keyword_vote",
    "WITH h AS (SELECT doc_id, " + ", ".join(f"{' + '.join(f'CAST(contains(lower(text), {quoted(w)}) AS INT)' for w in ws)} AS {k}" for k, ws in VOTES.items())
    + " FROM documents) SELECT doc_id, CASE WHEN positive > negative THEN 'POSITIVE' WHEN negative > positive THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS vote FROM h",
)
def keyword_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.keyword_vote(F.col("text"), VOTES["positive"], VOTES["negative"]).alias("vote"))


@query(
    "keyword_hits",
    "SELECT keyword, polarity, count(*) AS n_docs FROM documents JOIN (VALUES " + ", ".join(f"({quoted(w)}, {quoted(p)})" for p, ws in VOTES.items() for w in ws)
    + ") AS k(keyword, polarity) ON contains(lower(text), keyword) GROUP BY keyword, polarity",
)
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inlined as an array of literals: each text is scanned once and only counts are shuffled."""
    words = [F.struct(F.lit(w).alias("keyword"), F.lit(p).alias("polarity")) for p, ws in VOTES.items() for w in ws]
    low = table(spark, sf_dir, "documents").select(F.lower("text").alias("low"))
    hit = low.select(F.explode(F.filter(F.array(*words), lambda k: F.col("low").contains(k["keyword"]))).alias("k"))
    return hit.groupBy("k.keyword", "k.polarity").agg(F.count("*").alias("n_docs"))


@query("polarity_filter", f"WITH {LONG} SELECT doc_id AS review_id, aspect FROM cells WHERE neg = 1")
def polarity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scored(spark, sf_dir).select("review_id", F.explode("cells").alias("aspect", "cell"))
    return long.where(F.array_contains("cell.sentiments", "NEG")).select("review_id", "aspect")


@query("valid_scores", f"WITH {LONG} SELECT doc_id AS review_id, aspect, code FROM codes WHERE code <> 2")
def valid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy(spark, sf_dir).select("review_id", F.explode("codes").alias("aspect", "code")).where("code <> 2")


@query("score_offset_clamp", f"SELECT product_id, aspect, greatest(0, least(100, score + 65)) AS shifted FROM ({CARD_SQL})")
def score_offset_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aspect_scorecard(spark, sf_dir).select("product_id", "aspect", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + 65)).alias("shifted"))

"""Queries of tagger parameters, word classes and small conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import tokens as K
from aspectra.operators import models

from .quality import CASE_SQL, WORDS, tag_transitions, vocabulary, words
from .registry import query, quoted, table, values
from .scores import reviews

ALPHA = 0.1
DISCOUNT = 0.75

@query("case_pattern", f"WITH {WORDS} SELECT DISTINCT word, {CASE_SQL} AS pattern FROM w")
def case_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("word", K.case_pattern(F.col("word")).alias("pattern"))


ENDINGS = [(kind, e) for kind, own in K.ENDINGS.items() for e in own]


@query(
    "word_endings",
    f"WITH {WORDS}, v AS (SELECT DISTINCT lower(word) AS low FROM w) SELECT low, kind, ending, length(ending)::DOUBLE / length(low) AS share FROM v JOIN {values(ENDINGS, 'kind, ending')} ON ends_with(low, ending)",
)
def word_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = words(spark, sf_dir).select(F.lower("word").alias("low")).distinct()
    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("ending")) for k, e in ENDINGS])
    hit = low.select("low", F.explode(F.filter(known, lambda x: F.col("low").endswith(x["ending"]))).alias("x"))
    return hit.select("low", "x.kind", "x.ending", (F.length("x.ending") / F.length("low")).alias("share"))


@query("tag_initial", f"WITH {WORDS}, c AS (SELECT tag, count(*) FILTER (pos = 0) AS n FROM w GROUP BY tag) SELECT tag, (n + {ALPHA}::DOUBLE) / (sum(n) OVER () + {ALPHA}::DOUBLE * count(*) OVER ()) AS p FROM c")
def tag_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words(spark, sf_dir).groupBy("tag").agg(F.count_if(F.col("pos") == 0).alias("n"))
    total = c.agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(total)).select("tag", ((F.col("n") + ALPHA) / (F.col("s") + ALPHA * F.col("k"))).alias("p"))


@query(
    "tag_transitions_smoothed",
    f"""WITH {WORDS}, p AS (SELECT CASE WHEN pos % 2 = 0 THEN tag ELSE 'odd' END AS tag, lead(CASE WHEN pos % 2 = 0 THEN tag ELSE 'odd' END) OVER (PARTITION BY sent ORDER BY pos) AS nxt FROM w),
c AS (SELECT tag, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT tag FROM c), s AS (SELECT tag, sum(n) AS total, count(*) AS seen FROM c GROUP BY tag)
SELECT s.tag, t.tag AS nxt, round(greatest(coalesce(c.n, 0) - {DISCOUNT}::DOUBLE, 0) / total + {DISCOUNT}::DOUBLE * seen / total / (SELECT count(*) FROM t), 9) AS p FROM s CROSS JOIN t LEFT JOIN c ON c.tag = s.tag AND c.nxt = t.tag""",
)
def tag_transitions_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute discount with a uniform back-off; every pair of tags has its row."""
    c = tag_transitions(spark, sf_dir).drop("p")
    tags = c.select("tag").distinct().agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    s = c.groupBy("tag").agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.map_from_entries(F.collect_list(F.struct("nxt", "n"))).alias("m"))
    each = s.crossJoin(F.broadcast(tags)).select("tag", "total", "seen", "m", F.size("tags").alias("k"), F.explode("tags").alias("nxt"))
    n = F.coalesce(F.try_element_at("m", "nxt"), F.lit(0))
    p = F.greatest(n - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("seen") / F.col("total") / F.col("k")
    return each.select("tag", "nxt", F.round(p, 9).alias("p"))


@query(
    "tag_transitions_interpolated",
    f"""WITH {WORDS}, p AS (SELECT CASE WHEN pos % 2 = 0 THEN tag ELSE 'odd' END AS tag, lead(CASE WHEN pos % 2 = 0 THEN tag ELSE 'odd' END) OVER (PARTITION BY sent ORDER BY pos) AS nxt FROM w),
c AS (SELECT tag, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT tag FROM c), s AS (SELECT tag, sum(n) AS total, least(0.95::DOUBLE, 0.85::DOUBLE + 0.1::DOUBLE * sum(n) / (sum(n) + 50)) AS l FROM c GROUP BY tag)
SELECT s.tag, t.tag AS nxt, round(l * coalesce(c.n, 0) / total + (1 - l) / (SELECT count(*) FROM t), 9) AS p FROM s CROSS JOIN t LEFT JOIN c ON c.tag = s.tag AND c.nxt = t.tag""",
)
def tag_transitions_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed shares mixed with the uniform one, trusted the more the more of them there are."""
    c = tag_transitions(spark, sf_dir).drop("p")
    tags = c.select("tag").distinct().agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    s = c.groupBy("tag").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("nxt", "n"))).alias("m"))
    each = s.crossJoin(F.broadcast(tags)).select("tag", "total", "m", F.size("tags").alias("k"), F.explode("tags").alias("nxt"))
    trust = F.least(F.lit(0.95), 0.85 + 0.1 * F.col("total") / (F.col("total") + 50))
    n = F.coalesce(F.try_element_at("m", "nxt"), F.lit(0))
    return each.select("tag", "nxt", F.round(trust * n / F.col("total") + (1 - trust) / F.col("k"), 9).alias("p"))


@query(
    "tag_emissions",
    f"""WITH {WORDS}, c AS (SELECT tag, lower(word) AS word, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT tag, sum(n) AS total FROM c GROUP BY tag)
SELECT tag, word, round((n + {ALPHA}::DOUBLE) / (total + {ALPHA}::DOUBLE * (SELECT count(DISTINCT word) FROM c)), 12) AS p FROM c JOIN t USING (tag)""",
)
def tag_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words(spark, sf_dir).groupBy("tag", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    totals = c.groupBy("tag").agg(F.sum("n").alias("total"))
    size = c.agg(F.count_distinct("word").alias("v"))
    own = c.join(totals, "tag").crossJoin(F.broadcast(size))
    return own.select("tag", "word", F.round((F.col("n") + ALPHA) / (F.col("total") + ALPHA * F.col("v")), 12).alias("p"))


@query("star_order", "SELECT doc_id AS review_id, CAST(1 + doc_id % 5 AS INTEGER) AS rating FROM documents ORDER BY rating DESC, review_id LIMIT 100")
def star_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("review_id", "rating").orderBy(F.desc("rating"), "review_id").limit(100)


#: Lists written as text; the middle quotes are doubled in both engines' SQL.
IMAGES = """CASE page_id % 3 WHEN 0 THEN concat('[''', url, ''', ''b.png'']') WHEN 1 THEN '[]' END"""


@query("image_list", f"SELECT page_id AS n, array_to_string(regexp_extract_all({IMAGES}, '''([^'']*)''', 1), '|') AS images, CAST(len(regexp_extract_all({IMAGES}, '''([^'']*)''', 1)) AS INTEGER) AS size FROM pages")
def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that was written as text, as an array again."""
    df = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), F.expr(IMAGES).alias("raw"))
    items = F.regexp_extract_all("raw", F.lit("'([^']*)'"), F.lit(1))
    return df.select("n", F.array_join(items, "|").alias("images"), F.when(F.col("raw").isNotNull(), F.size(items)).alias("size"))


@query("present_columns", "SELECT doc_id, quality FROM labels")
def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the expected columns that a table has, names stripped."""
    df = table(spark, sf_dir, "labels").withColumnRenamed("quality", " quality ")
    clean = df.toDF(*[c.strip() for c in df.columns])
    return clean.select(*[c for c in ("doc_id", "quality", "price") if c in clean.columns])


@query("svd_features", None)
def svd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the space of the largest singular vectors of their word counts."""
    return models.svd(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 10, 300)


PSEUDO_SQL = (
    f"CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'NUM' WHEN {CASE_SQL} = 'ALL_UPPER' THEN 'ALLCAPS' WHEN {CASE_SQL} = 'TITLE_CASE' THEN 'CAP' WHEN ends_with(lower(word), 'ing') THEN 'SUFFIX_ING' "
    + " ".join(f"WHEN regexp_matches(word, {quoted(p)}) THEN {quoted(n)}" for n, p in K.TOKEN_CLASSES)
    + " ELSE 'WORD' END"
)


@query("pseudo_words", f"WITH {WORDS}, c AS (SELECT lower(word) AS low, count(*) AS n FROM w GROUP BY ALL), v AS (SELECT DISTINCT word FROM w) SELECT word, CASE WHEN c.n >= 3 THEN low ELSE '<' || {PSEUDO_SQL} || '>' END AS token FROM v JOIN c ON c.low = lower(v.word)")
def pseudo_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words by their class."""
    own = words(spark, sf_dir).select("word", F.lower("word").alias("low"))
    n = own.groupBy("low").agg(F.count("*").alias("n"))
    token = F.when(F.col("n") >= 3, F.col("low")).otherwise(F.concat(F.lit("<"), K.pseudo_class(F.col("word")), F.lit(">")))
    return own.distinct().join(n, "low").select("word", token.alias("token"))

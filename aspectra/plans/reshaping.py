"""Queries that dedup, join, sample, sort and combine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.functions import text as T
from aspectra.operators import ranks
from aspectra.operators import reviews as R

from .registry import query, table
from .scores import W, reviews

KEY = f"regexp_replace(regexp_replace(lower(regexp_replace(text, '^{W}+|{W}+$', '', 'g')), '{T.SIGN}', '', 'g'), '{W}+', '', 'g')"
FILLED = f"length(regexp_replace(text, '^{W}+|{W}+$', '', 'g')) > 0"


@query(
    "fuzzy_dedup_first",
    f"SELECT review_id FROM (SELECT doc_id AS review_id, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS n FROM documents WHERE {FILLED}) WHERE n = 1",
)
def fuzzy_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuzzy_dedup(reviews(spark, sf_dir), "text", [F.col("review_id")]).select("review_id")


@query(
    "dedup_last",
    "SELECT seq, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq DESC) AS n FROM (SELECT doc_id AS seq, text FROM documents UNION ALL SELECT 1000000 + doc_id, text FROM documents WHERE doc_id % 3 = 0)) WHERE n = 1",
)
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "text")
    new = old.where("seq % 3 = 0").selectExpr("1000000 + seq AS seq", "text")
    return R.keep_first(old.unionByName(new), F.col("text"), [F.col("seq")], last=True)


@query("upsert_new_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return R.new_rows(docs.unionByName(docs), table(spark, sf_dir, "labels"), "doc_id", [F.col("n_chars")]).select("doc_id")


@query("known_rows", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def known_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "product_status",
    """WITH p AS (SELECT 'src' || i AS product_id FROM range(0, 26) t(i)),
c AS (SELECT source AS product_id, count(*) AS n, max(doc_id) AS last_update FROM documents GROUP BY source),
d AS (SELECT DISTINCT d.source AS product_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0),
g AS (SELECT DISTINCT 'src' || (item_id % 25) AS product_id FROM benchmark)
SELECT product_id, CASE WHEN c.n IS NOT NULL AND d.product_id IS NOT NULL THEN 'completed' WHEN c.n IS NOT NULL OR g.product_id IS NOT NULL THEN 'processing' ELSE 'not_found' END AS status,
  coalesce(c.n, 0) AS review_count, c.last_update FROM p LEFT JOIN c USING (product_id) LEFT JOIN d USING (product_id) LEFT JOIN g USING (product_id)""",
)
def product_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every side is aggregated to products before it is joined."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    product = lambda c: F.concat(F.lit("src"), c.cast("string"))
    asked = spark.range(26).select(product(F.col("id")).alias("product_id"))
    counts = docs.groupBy(F.col("source").alias("product_id")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_update"))
    done = docs.select("doc_id", "source").join(labels.where("quality = 0").select("doc_id"), "doc_id").select(F.col("source").alias("product_id"), F.lit(True).alias("done")).distinct()
    triggers = table(spark, sf_dir, "benchmark").select(product(F.col("item_id") % 25).alias("product_id"), F.lit(True).alias("asked")).distinct()
    joined = asked.join(counts, "product_id", "left").join(done, "product_id", "left").join(triggers, "product_id", "left")
    status = F.when(F.col("n").isNotNull() & F.col("done").isNotNull(), "completed").when(F.col("n").isNotNull() | F.col("asked").isNotNull(), "processing").otherwise("not_found")
    return joined.select("product_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("review_count"), "last_update")


@query("top_products", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "o_custkey").limit(10)


@query("last_events", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_group(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("url_distinct", "SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def url_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query(
    "star_counts",
    "SELECT source AS product_id, count(*) FILTER (1 + doc_id % 5 <= 3) AS low, count(*) FILTER (1 + doc_id % 5 > 3) AS high, count(*) FILTER (1 + doc_id % 5 = 5) AS five FROM documents GROUP BY source",
)
def star_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).groupBy("product_id").agg(F.count_if(F.col("rating") <= 3).alias("low"), F.count_if(F.col("rating") > 3).alias("high"), F.count_if(F.col("rating") == 5).alias("five"))


RATED = "SELECT doc_id AS review_id, CAST(CASE WHEN doc_id % 10 = 0 THEN 1 WHEN doc_id % 10 = 1 THEN 2 + doc_id % 2 WHEN doc_id % 10 < 5 THEN 4 ELSE 5 END AS INTEGER) AS rating FROM documents"


@query(
    "balanced_sample",
    f"""WITH r AS ({RATED}), k AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY review_id) AS n FROM r),
low AS (SELECT count(*) AS c FROM k WHERE rating <= 3 AND n <= 20),
q AS (SELECT c, greatest(5, c // 2) AS h, (SELECT count(*) FROM k WHERE rating = 4) AS have4 FROM low),
f AS (SELECT c, least(have4, least(h, c)) AS fours, least(h, c - least(have4, least(h, c))) AS fives FROM q)
SELECT review_id, rating FROM (SELECT review_id, rating FROM k, f WHERE c = 0 OR n <= CASE WHEN rating <= 3 THEN 20 WHEN rating = 4 THEN fours ELSE fives END
  ORDER BY CASE WHEN c > 0 THEN rating ELSE 0 END, review_id LIMIT 100)""",
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 10
    rating = F.when(m == 0, 1).when(m == 1, 2 + F.col("doc_id") % 2).when(m < 5, 4).otherwise(5).cast("int")
    rated = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), rating.alias("rating"))
    return R.balanced_sample(rated, "rating", [F.col("review_id")], 100)


@query("first_n_per_group", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_group(table(spark, sf_dir, "documents"), ["source"], [F.col("doc_id")], 5).select("doc_id", "source")


@query("first_links", "SELECT DISTINCT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first five rows of a group name, each once: rows are cut before repeats go."""
    return R.first_per_group(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], [F.col("doc_id")], 5).select("source", "lang").distinct()


HASH = "(doc_id * 7919 + 104729) % 1000003"


@query("split_80_20", f"SELECT doc_id, {HASH} % 100 >= 80 AS held_out FROM documents")
def split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{HASH} % 100 >= 80 AS held_out")


@query(
    "stratified_split",
    f"SELECT doc_id, quality, percent_rank() OVER (PARTITION BY quality ORDER BY {HASH}, doc_id) >= 0.8 AS held_out FROM labels",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of each label in the order of the hash, ranked in buckets."""
    own = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality", f"{HASH} AS h")
    total = own.groupBy("quality").agg(F.count("*").alias("n"))
    ranked = ranks.running(own, "h", "k", ("quality",), ("doc_id",), bounds=hash_bounds(own)).join(F.broadcast(total), "quality")  # as many rows as labels
    return ranked.select("doc_id", "quality", (F.when(F.col("n") > 1, (F.col("k") - 1) / (F.col("n") - 1)).otherwise(0.0) >= 0.8).alias("held_out"))


def hash_bounds(df: DataFrame) -> list[int]:
    """Even cuts of the hash's range."""
    n = ranks.width(df)
    return [k * 1000003 // n for k in range(1, n)]


@query("kfold", f"SELECT doc_id, CAST({HASH} % 5 AS INTEGER) AS fold FROM documents")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"CAST({HASH} % 5 AS INT) AS fold")


@query("first_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(50)


@query("random_n", f"SELECT doc_id FROM documents ORDER BY {HASH}, doc_id LIMIT 200")
def random_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.expr(HASH), "doc_id").limit(200)


@query("shuffled_order", f"SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) AS place FROM documents")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global ranks: the count of the buckets before plus the rank inside, so no task sees all rows."""
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{HASH} AS h")
    return ranks.running(own, "h", "place", order=("doc_id",), bounds=hash_bounds(own)).select("doc_id", F.col("place").cast("long").alias("place"))


@query(
    "union_frames",
    "SELECT doc_id AS id, text, NULL::VARCHAR AS url, 'documents' AS origin FROM documents UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages",
)
def union_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("pages").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


@query("random_attributes", f"SELECT doc_id, ['phone', 'book', 'shoe', 'lamp'][CAST({HASH} % 4 AS INTEGER) + 1] AS category FROM documents")
def random_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("phone", "book", "shoe", "lamp")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(names, F.expr(f"CAST({HASH} % 4 AS INT)")).alias("category"))


@query("reattach_dims", "SELECT d.doc_id, d.source, l.quality, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def reattach_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.withColumn("label", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")))


@query("target_projection", "SELECT d.text AS content, l.quality AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.quality <> 2 AND d.text IS NOT NULL")
def target_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality <> 2").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).join(labels, "doc_id").dropna(subset=["content", "label"]).drop("doc_id")


@query("wide_exclude", "SELECT quality, toxic FROM labels")
def wide_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").drop("doc_id", "absent")


@query("star_filter", "SELECT doc_id AS review_id FROM documents WHERE 1 + doc_id % 5 = 4")
def star_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).where("rating = 4").select("review_id")


@query("text_filter", f"SELECT doc_id AS review_id FROM documents WHERE {FILLED} AND n_chars > 200")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.length(T.strip(F.col("text"))) > 0
    return table(spark, sf_dir, "documents").where(filled & (F.col("n_chars") > 200)).select(F.col("doc_id").alias("review_id"))


@query("completion_check", "SELECT source AS product_id, count(DISTINCT doc_id) AS stored, count(DISTINCT doc_id) >= 50 AS complete FROM documents GROUP BY source")
def completion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reviews(spark, sf_dir).groupBy("product_id").agg(F.count_distinct("review_id").alias("stored"))
    return n.withColumn("complete", F.col("stored") >= 50)


@query("insert_if_absent", "SELECT doc_id, 'kept' AS state FROM labels UNION ALL SELECT doc_id, 'added' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id")
    new = table(spark, sf_dir, "documents").select("doc_id").join(old, "doc_id", "left_anti")
    return old.withColumn("state", F.lit("kept")).unionByName(new.withColumn("state", F.lit("added")))


@query(
    "update_by_key",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false)",
)
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of matching keys replace the old ones; keys marked for deletion go."""
    labels = table(spark, sf_dir, "labels")
    updated = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("old")).join(labels.select("doc_id", "quality"), "doc_id", "left")
    return updated.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.coalesce("quality", "old").alias("quality"))


@query("distinct_links", """SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)""")
def distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).distinct()


@query("keyword_nunique", "SELECT count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents")
def keyword_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"))

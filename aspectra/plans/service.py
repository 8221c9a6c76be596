"""Queries over files, the service's tables and pluggable scorers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import sentiment as S
from aspectra.functions import text as T
from aspectra.operators import gateway as G
from aspectra.operators import models
from aspectra.operators import reviews as R
from aspectra.sources import files
from aspectra.streaming.pipeline import spread

from .registry import query, table
from .scores import CARD_SQL, LEXICON, LONG, W, legacy, reviews, scored


def _saved(spark: SparkSession, sf_dir: str) -> str:
    """Reviews by product, half of them in the typed code and half in the legacy one."""
    folder = files.scratch(spark, "service")
    df = legacy(spark, sf_dir).select(F.col("review_id").cast("string").alias("review_id"), "text", F.when(F.col("review_id") % 2 == 0, F.to_json("cells")).otherwise(F.to_json("codes")).alias("sentiment"), "product_id")
    G.save_reviews(df, folder)
    return folder


@query("list_predictions", "SELECT source AS product_id, count(*) AS review_count, true AS dated FROM documents GROUP BY source")
def list_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = files.shown_time(F.col("last_modified"))
    return G.listing(spark, _saved(spark, sf_dir)).select("product_id", "review_count", shown.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$").alias("dated"))


@query(
    "product_prediction",
    f"""WITH {LONG}, x AS (SELECT source, aspect, m, CASE WHEN doc_id % 2 = 0 THEN neg WHEN code = -1 THEN 1 ELSE 0 END AS neg, CASE WHEN doc_id % 2 = 0 THEN pos WHEN code = 1 THEN 1 ELSE 0 END AS pos,
  CASE WHEN doc_id % 2 = 0 THEN neu WHEN code = 0 THEN 1 ELSE 0 END AS neu FROM codes),
s AS (SELECT source, aspect, count(*) FILTER (m) AS review_count, CAST(sum(neg) AS DOUBLE) AS n, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neu) AS DOUBLE) AS u, bool_or(neg + pos + neu > 1) AS has_mixed FROM x GROUP BY ALL)
SELECT source AS product_id, aspect, CASE WHEN n + p + u > 0 THEN round_even((100 * p + 50 * u) / (n + p + u), 1) ELSE 50 END AS score, review_count, has_mixed FROM s""",
)
def product_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards out of stored payloads of both codes."""
    return G.scorecards(G.product_reviews(spark, _saved(spark, sf_dir))).select("product_id", "aspect", "score", "review_count", "has_mixed")


@query("summary_sink", f"SELECT product_id, aspect, score, review_count FROM ({CARD_SQL})")
def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries written by product with their markers, read back."""
    folder = files.scratch(spark, "summary")
    G.save_summary(R.scorecard(scored(spark, sf_dir), "cells", ["product_id"]), folder)
    done = G.statuses(spark, folder, table(spark, sf_dir, "documents").select(F.col("source").alias("product_id")))
    assert done.where("review_count > 0").isEmpty(), "no reviews are stored here"
    return G.summaries(spark, folder).select("product_id", "aspect", "score", "review_count")


@query(
    "service_status",
    """WITH p AS (SELECT source AS product_id, count(*) AS n, row_number() OVER (ORDER BY source) AS k FROM documents GROUP BY source)
SELECT product_id, CASE WHEN k % 3 = 0 THEN 'completed' WHEN k % 3 = 1 THEN 'processing' ELSE 'not_found' END AS status, CASE WHEN k % 3 = 2 THEN 0 ELSE n END AS review_count FROM p
UNION ALL SELECT '777', 'processing', 0 UNION ALL SELECT 'nobody', 'not_found', 0""",
)
def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and done, stored only, asked for only, unknown."""
    folder = files.scratch(spark, "status")
    names = sorted(r[0] for r in table(spark, sf_dir, "documents").select("source").distinct().collect())
    place = {n: k % 3 for k, n in enumerate(names, 1)}
    own = legacy(spark, sf_dir).select(F.col("review_id").cast("string").alias("review_id"), "text", F.to_json("codes").alias("sentiment"), "product_id")
    G.save_reviews(own.where(F.col("product_id").isin([n for n, k in place.items() if k != 2])), folder)
    G.save_summary(spark.createDataFrame([(n, "a", 50.0) for n, k in place.items() if k == 0], "product_id string, aspect string, score double"), folder)
    G.save_trigger(spark, folder, "https://shop.example/products/cup-i777-s1.html")
    return G.statuses(spark, folder, spark.createDataFrame([(n,) for n in [*names, "777", "nobody"]], "product_id string"))


@query("clear_predictions", "SELECT count(DISTINCT source) AS gone, CAST(0 AS BIGINT) AS left_over FROM documents")
def clear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _saved(spark, sf_dir)
    gone = G.clear(spark, folder)
    return G.product_reviews(spark, folder).agg(F.lit(gone).cast("long").alias("gone"), F.count("*").alias("left_over"))


@query("replace_product", "SELECT source AS product_id, CASE WHEN source = (SELECT min(source) FROM documents) THEN CAST(1 AS BIGINT) ELSE count(*) END AS n FROM documents GROUP BY source")
def replace_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run of one product takes the place of its old reviews; the others stay."""
    folder = _saved(spark, sf_dir)
    first = table(spark, sf_dir, "documents").agg(F.min("source").alias("product_id"))
    G.save_reviews(first.select(F.lit("new").alias("review_id"), F.lit("text").alias("text"), F.lit("{}").alias("sentiment"), "product_id"), folder)
    return G.product_reviews(spark, folder).groupBy("product_id").agg(F.count("*").alias("n"))


@query("pandas_scorer", f"WITH {LONG} SELECT doc_id AS review_id, aspect, code FROM codes")
def pandas_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword rules in Python; the preferred model cannot be made, so the next one is."""

    def broken() -> models.Scorer:
        raise FileNotFoundError("no artefact")

    make = models.preferred(broken, lambda: models.KeywordScorer(LEXICON))
    found = models.predictions(spread(reviews(spark, sf_dir), salts=16), make, "text", "legacy")
    return found.select("review_id", F.explode("codes").alias("aspect", "code"))


def _reply(text: str) -> str:
    """What a language model might say about a text; texts with 'zz' break it."""
    if "zz" in text:
        return "here you are: {broken"
    scorer = models.KeywordScorer(LEXICON)
    words = {1: "POS", -1: "NEG", 0: "NEU"}
    return "Sure! " + json.dumps({a: words[c] for a, c in zip(scorer.aspects, scorer.predict([text])[0], strict=True) if c != 2}, ensure_ascii=False) + " Anything else?"


@query("reply_scorer", f"WITH {LONG} SELECT doc_id AS review_id, aspect, CASE WHEN contains(text, 'zz') THEN 2 ELSE code END AS code FROM codes JOIN (SELECT doc_id, text FROM documents) USING (doc_id)")
def reply_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A back-end that answers text by text, its replies parsed; a reply without an object mentions nothing."""
    found = models.predictions(reviews(spark, sf_dir), lambda: models.ReplyScorer(_reply), "text", "legacy")
    return found.select("review_id", F.explode("codes").alias("aspect", "code"))


@query("scorer_formats", f"WITH {LONG} SELECT doc_id AS review_id, aspect, code, code <> 2 AS mentioned, CASE code WHEN 1 THEN 'POS' WHEN -1 THEN 'NEG' WHEN 0 THEN 'NEU' END AS label FROM codes")
def scorer_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both output formats at once agree cell by cell."""
    found = models.predictions(reviews(spark, sf_dir), lambda: models.KeywordScorer(LEXICON), "text", "both")
    long = found.select("review_id", "cells", F.explode("codes").alias("aspect", "code"))
    cell = F.try_element_at("cells", F.col("aspect"))
    return long.select("review_id", "aspect", "code", cell["mentioned"].alias("mentioned"), F.array_join(cell["sentiments"], ",").alias("label"))


@query("scorer_failure", "SELECT doc_id AS review_id, CAST(0 AS BIGINT) AS said, true AS failed FROM documents")
def scorer_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails gives every row the empty prediction and the reason."""

    class Failing(models.KeywordScorer):
        def predict(self, texts: list[str]) -> list[list[int]]:
            raise RuntimeError("out of order")

    found = models.predictions(reviews(spark, sf_dir), lambda: Failing(LEXICON), "text", "legacy")
    said = F.size(F.filter(F.map_values("codes"), lambda c: c != 2)).cast("long")
    return found.select("review_id", said.alias("said"), (F.col("error") == "RuntimeError: out of order").alias("failed"))


@query("scan_json_array", "SELECT doc_id, sha256(text) AS text_sha FROM documents")
def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one JSON array each beside a broken one."""
    path = files.scratch(spark, "arrays")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = docs.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("k")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    packed.write.partitionBy("k").text(path)  # one array a file
    spark.createDataFrame([(8, '[{"doc_id": 1, "text": "cut')], "k long, value string").write.mode("append").partitionBy("k").text(path)
    return files.read_json_array(spark, path, "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query("scan_json_only", "SELECT doc_id FROM documents")
def scan_json_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the files whose names end in .json are read."""
    path = files.scratch(spark, "mixed")
    table(spark, sf_dir, "documents").select("doc_id").write.json(path)
    table(spark, sf_dir, "documents").selectExpr("to_json(struct(-doc_id AS doc_id)) AS value").write.mode("append").text(path)
    return spark.read.schema("doc_id long").json(path, pathGlobFilter="*.json")


@query("scan_csv_union", "SELECT doc_id, lang, NULL::VARCHAR AS source FROM documents UNION ALL SELECT doc_id, NULL, source FROM documents")
def scan_csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CSV folders with different columns."""
    path, docs = files.scratch(spark, "union"), table(spark, sf_dir, "documents")
    for name in ("lang", "source"):
        files.write_csv(docs.select("doc_id", name), f"{path}/{name}")
    both = files.read_union(spark, [f"{path}/lang", f"{path}/source"])
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source")


@query("scan_csv_drop_bad", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0")
def scan_csv_drop_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number is none are left out."""
    path = files.scratch(spark, "bad")
    bad = F.when(F.col("doc_id") % 3 == 0, F.lit("many")).otherwise(F.col("n_chars").cast("string"))
    table(spark, sf_dir, "documents").select("doc_id", bad.alias("n_chars")).write.options(**files.CSV).csv(path)
    return files.read_csv(spark, path, "doc_id long, n_chars long", drop_bad=True)


@query("scan_heads", "SELECT k AS folder, count(*) AS n FROM (SELECT doc_id % 3 AS k, row_number() OVER (PARTITION BY doc_id % 3) AS r FROM documents) WHERE r <= 5 GROUP BY k")
def scan_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each file."""
    path = files.scratch(spark, "heads")
    for k in range(3):
        files.write_csv(table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == k).select("doc_id", F.lit(k).alias("folder")).coalesce(1), f"{path}/{k}")
    own = files.read_csv(spark, [f"{path}/{k}" for k in range(3)], "doc_id long, folder long")
    return files.heads(own).groupBy("folder").agg(F.count("*").alias("n"))


@query("kpi_text", "SELECT source, printf('%.1f%%', round_even(100.0::DOUBLE * count(*) FILTER (lang = 'en') / count(*), 1)) AS share, printf('%.1f/100', round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 1)) AS score FROM documents GROUP BY source")
def kpi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares as text for people to read."""
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("total"))
    own = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en")).crossJoin(F.broadcast(total))
    return own.select("source", T.percent(100.0 * F.col("en") / F.col("n")).alias("share"), T.percent(F.col("n") * 100.0 / F.col("total"), "/100").alias("score"))


@query("segment_words", f"SELECT doc_id, text AS plain, regexp_replace(text, '{W}+', '_', 'g') AS joined FROM documents")
def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word segmentation: without a segmenter a text stays as it is."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.segment(text).alias("plain"), T.segment(text, lambda c: F.regexp_replace(c, f"{W}+", "_")).alias("joined"))

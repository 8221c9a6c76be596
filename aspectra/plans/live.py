"""Queries over files, streams and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import sentiment as S
from aspectra.operators import models
from aspectra.operators import reviews as R
from aspectra.sources import files
from aspectra.streaming import pipeline

from .quality import words
from .registry import query, table
from .scores import CARD_SQL, LEXICON, LONG, reviews


@query("scan_parquet_filter", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars > 1000")
def scan_parquet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'de' AND n_chars > 1000").select("doc_id", "n_chars")


@query("scan_json_roundtrip", "SELECT doc_id, sha256(text) AS text_sha, lang FROM documents")
def scan_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "json")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(path)
    return spark.read.schema("doc_id long, text string, lang string").json(path).select("doc_id", F.sha2("text", 256).alias("text_sha"), "lang")


@query("scan_csv_roundtrip", "SELECT doc_id, sha256(text) AS text_sha, lang FROM documents")
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return files.read_csv(spark, path, "doc_id long, text string, lang string").select("doc_id", F.sha2("text", 256).alias("text_sha"), "lang")


@query("scan_text_urls", "SELECT url FROM pages")
def scan_text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "urls")
    quoted_lines = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("“"), "url", F.lit("”"))).otherwise(F.concat(F.lit('"'), "url", F.lit('"')))
    table(spark, sf_dir, "pages").select(quoted_lines).write.text(path)
    return files.url_lines(spark, path)


@query("header_sniff", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality FROM labels")
def header_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header is the third line of the file."""
    path = files.scratch(spark, "sniff")
    body = table(spark, sf_dir, "labels").select(F.concat_ws(",", F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("value"), F.lit(1).alias("k"), F.col("doc_id").alias("i"))
    top = spark.createDataFrame([("notes,", 0, 0), (",", 0, 1), (" doc_id , quality", 0, 2)], "value string, k int, i long")
    top.unionByName(body).coalesce(1).sortWithinPartitions("k", "i").select("value").write.text(path)  # one small file, as such sheets are
    return files.sniff_header(spark, path, "quality")


def _streamed(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """Documents as a stream of JSON events, parsed, scored and upserted ``times`` times over."""
    schema = table(spark, sf_dir, "documents").schema
    out = files.scratch(spark, "stream")
    for k in range(times):
        docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, for a stream's path must not be a file
        event = F.struct(F.col("source").alias("product_id"), F.col("text").alias("review_content"), F.col("doc_id").cast("string").alias("review_id"))
        live = pipeline.score(pipeline.parse(docs.select(F.to_json(event).alias("value"))), LEXICON)
        run = pipeline.run(live, pipeline.upsert_sink(f"{out}/table"), f"{out}/checkpoint-{k}", f"reviews_{k}")
        run.awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query("stream_parse_score", f"WITH {LONG} SELECT CAST(doc_id AS VARCHAR) AS review_id, aspect, code FROM codes")
def stream_parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).select("review_id", F.explode("sentiment").alias("aspect", "cell")).select("review_id", "aspect", S.to_legacy(F.col("cell")).alias("code"))


@query("stream_scorecard", CARD_SQL)
def stream_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scorecard(_streamed(spark, sf_dir), "sentiment", ["product_id"])


@query("stream_replay", "SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS product_id FROM documents")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream twice, with a lost checkpoint between: every id is there once."""
    return _streamed(spark, sf_dir, times=2).select("review_id", "product_id")


STAMP = "'%Y-%m-%d %H:%M:%S'"
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("events_tumbling", f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), {STAMP}) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.windowed(timed(spark, sf_dir), "ts", ["event_type"], "1 hour").withColumn("start", _stamp("start"))


@query(
    "events_sliding",
    f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour', {STAMP}) AS start, event_type, count(*) AS n FROM events, range(0, 3) r(k) GROUP BY ALL",
)
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.windowed(timed(spark, sf_dir), "ts", ["event_type"], "3 hours", "1 hour").withColumn("start", _stamp("start"))


@query(
    "events_session",
    f"""WITH g AS (SELECT user_id, ts, coalesce(CAST(ts - lag(ts) OVER w > INTERVAL '6 hours' AS INT), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), {STAMP}) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timed(spark, sf_dir).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", _stamp("w.start").alias("start"), "n")


@query("events_dedup", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_first(timed(spark, sf_dir), F.struct("user_id", "event_type"), [F.col("ts"), F.col("event_id")]).select("event_id")


@query("nb_predict", None)
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    own = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id").withColumn("fold", F.expr("(doc_id * 7919 + 104729) % 1000003 % 5"))
    return models.naive_bayes(own.where("fold > 0"), own.where("fold = 0"), "text", "label").select("doc_id", "label", "prediction")


@query("viterbi_tags", None)
def viterbi_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.tag(words(spark, sf_dir))

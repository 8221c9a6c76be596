"""Queries that run streams: batches, two outputs, replays, windows, joins."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import sentiment as S
from aspectra.operators import reviews as R
from aspectra.sources import files
from aspectra.streaming import batcher, pipeline

from .live import STAMP
from .registry import query, table
from .scores import LEXICON, LONG, reviews

WAIT_S = 120.0


def _live(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A table as a stream."""
    schema = table(spark, sf_dir, name).schema
    own = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, for a stream's path must not be a file
    return own.withColumns({c: F.expr(e) for c, e in (columns or {}).items()})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON events."""
    event = F.struct(F.col("source").alias("product_id"), F.col("text").alias("review_content"), F.col("doc_id").cast("string").alias("review_id"), F.lit("5").alias("rating"))
    return _live(spark, sf_dir, "documents").select(F.to_json(event).alias("value"))


@query(
    "stream_batches",
    "SELECT event_type AS key, CAST(sum(n) AS BIGINT) AS ids, CAST(sum(n // 32) AS BIGINT) AS full_batches, CAST(count(*) FILTER (n % 32 > 0) AS BIGINT) AS rest_batches FROM (SELECT event_type, user_id % 7 AS u, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
)
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 ids a key, and what is left once nothing more has come for two seconds."""
    out = files.scratch(spark, "batches")
    live = _live(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string")).alias("key"), F.col("event_id").cast("string").alias("id"))
    wanted = table(spark, sf_dir, "events").count()
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/table/batch_id={k}")
    running = pipeline.run(batcher.batches(live, timeout_ms=2000), sink, f"{out}/checkpoint", "batches", every="1 second")
    schema = f"{batcher.SCHEMA}, batch_id long"

    def seen() -> int:
        if running.exception() is not None:
            raise running.exception()
        done = [r["n"] for r in running.recentProgress and spark.read.schema(schema).parquet(f"{out}/table").agg(F.sum(F.size("ids")).alias("n")).collect()]
        return (done and done[0]) or 0

    try:
        pipeline.wait_for(seen, wanted, WAIT_S, 0.5)
    finally:
        running.stop()
    got = spark.read.schema(schema).parquet(f"{out}/table").withColumn("key", F.split_part("key", F.lit(":"), F.lit(1)))
    return got.groupBy("key").agg(F.sum(F.size("ids")).alias("ids"), F.count_if(F.col("reason") == "count").alias("full_batches"), F.count_if(F.col("reason") == "timeout").alias("rest_batches"))


@query("stream_output", "SELECT source AS product_id, CAST(doc_id AS VARCHAR) AS review_id, text AS original_text, '5' AS rating, true AS stamped, 9 AS n_aspects, 7 AS n_columns FROM documents")
def stream_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven outgoing columns, stamped when they were processed."""
    out, began = files.scratch(spark, "output"), time.time()
    live = pipeline.outgoing(pipeline.score(pipeline.parse(_events(spark, sf_dir)), LEXICON))
    pipeline.run(live, pipeline.upsert_sink(f"{out}/table"), f"{out}/checkpoint", "output").awaitTermination()
    df = spark.read.parquet(f"{out}/table").select(*pipeline.OUTPUT)
    stamped = F.col("processed_at").between(F.timestamp_seconds(F.lit(began - 1)), F.current_timestamp())
    return df.select("product_id", "review_id", "original_text", "rating", stamped.alias("stamped"), F.size(F.from_json("sentiment_json", S.TYPED)).alias("n_aspects"), F.lit(len(df.columns)).alias("n_columns"))


@query("stream_two_outputs", "SELECT source AS key, CAST(doc_id AS VARCHAR) AS review_id, true AS in_table FROM documents")
def stream_two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table and messages hold the same rows once, though the stream ran twice with its checkpoint lost between."""
    out = files.scratch(spark, "two")
    for k in range(2):
        live = pipeline.outgoing(pipeline.score(pipeline.parse(_events(spark, sf_dir)), LEXICON))
        sink = pipeline.upsert_sink(f"{out}/table", extra=pipeline.message_sink(f"{out}/messages"))
        pipeline.run(live, sink, f"{out}/checkpoint-{k}", f"two_{k}").awaitTermination()
    sent = pipeline.read_messages(spark, f"{out}/messages").select("key", F.get_json_object("value", "$.review_id").alias("review_id"))
    stored = spark.read.parquet(f"{out}/table").select("review_id", F.lit(True).alias("in_table"))
    return sent.join(stored, "review_id", "left").select("key", "review_id", "in_table")


@query("stream_relay", f"WITH {LONG} SELECT source AS key, CAST(doc_id AS VARCHAR) AS review_id, aspect, code FROM codes")
def stream_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in, scored messages out, read back."""
    out = files.scratch(spark, "relay")
    pipeline.relay(_events(spark, sf_dir), LEXICON, f"{out}/messages", f"{out}/checkpoint").awaitTermination()
    got = pipeline.read_messages(spark, f"{out}/messages").select("key", F.from_json("value", f"review_id string, sentiment {S.TYPED}").alias("v"))
    return got.select("key", "v.review_id", F.explode("v.sentiment").alias("aspect", "cell")).select("key", "review_id", "aspect", S.to_legacy(F.col("cell")).alias("code"))


@query("stream_paced", "SELECT doc_id, source FROM documents")
def stream_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replayed a file a trigger: no batch holds more than one file, none is lost."""
    out = files.scratch(spark, "paced")
    live = pipeline.replay(table(spark, sf_dir, "documents").select("doc_id", "source"), f"{out}/in", files=3)
    live = live.select(F.from_json("value", "doc_id long, source string").alias("v"), F.input_file_name().alias("file")).select("v.*", "file")
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/table/batch_id={k}")
    pipeline.run(live, sink, f"{out}/checkpoint", "paced").awaitTermination()
    got = spark.read.parquet(f"{out}/table")
    most = got.groupBy("batch_id").agg(F.count_distinct("file").alias("n")).agg(F.max("n").alias("n"))
    return got.crossJoin(F.broadcast(most)).where("n = 1").select("doc_id", "source")


@query("stream_dedup", "SELECT event_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream united with itself, each id once within the watermark."""
    out = files.scratch(spark, "dedup")
    own = lambda: _live(spark, sf_dir, "events", {"ts": "CAST(ts AS TIMESTAMP)"}).withWatermark("ts", "400 days")
    live = own().union(own()).dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/table/batch_id={k}")
    pipeline.run(live, sink, f"{out}/checkpoint", "dedup").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("event_id")


@query("stream_windows", f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), {STAMP}) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts under a watermark; of what a window sent, the last batch counts."""
    out = files.scratch(spark, "windows")
    live = pipeline.windowed(_live(spark, sf_dir, "events", {"ts": "CAST(ts AS TIMESTAMP)"}), "ts", ["event_type"], "1 hour")
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/table/batch_id={k}")
    pipeline.run(live, sink, f"{out}/checkpoint", "windows", mode="update").awaitTermination()
    got = spark.read.parquet(f"{out}/table").groupBy("start", "event_type").agg(F.max_by("n", "batch_id").alias("n"))
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    "stream_join",
    "SELECT a.event_id AS first_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1 hour'",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams: what a user did within the hour after each event; both sides forget what the watermark has passed."""
    out = files.scratch(spark, "join")

    def side(*names: str) -> DataFrame:
        own = _live(spark, sf_dir, "events", {"ts": "CAST(ts AS TIMESTAMP)"}).withWatermark("ts", "2 hours")
        return own.select(*[F.col(c).alias(n) for c, n in zip(("event_id", "user_id", "ts"), names, strict=True)])

    a, b = side("first_id", "user_a", "ts_a"), side("next_id", "user_b", "ts_b")
    live = a.join(b, F.expr("user_a = user_b AND ts_b > ts_a AND ts_b <= ts_a + INTERVAL 1 HOUR")).select("first_id", "next_id")
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/table/batch_id={k}")
    pipeline.run(live, sink, f"{out}/checkpoint", "joined").awaitTermination()
    return spark.read.schema("first_id long, next_id long").parquet(f"{out}/table").select("first_id", "next_id")


@query("stream_model_switch", "SELECT CAST(doc_id AS VARCHAR) AS review_id, 'second' AS model FROM documents")
def stream_model_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config names another model between two runs: the second takes it, a broken config falls back to the default."""
    out = files.scratch(spark, "switch")
    named = lambda n: lambda df: df.withColumn("model", F.lit(n))
    for k, config in enumerate(("not json", '{"model": "second"}')):
        spark.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/config")
        sink = pipeline.switching({"keyword": named("keyword"), "second": named("second")}, f"{out}/config", pipeline.upsert_sink(f"{out}/table-{k}"))
        pipeline.run(pipeline.parse(_events(spark, sf_dir)), sink, f"{out}/checkpoint-{k}", f"switch_{k}").awaitTermination()
    first, second = (spark.read.parquet(f"{out}/table-{k}").select("review_id", "model") for k in range(2))
    return second.join(first.where("model = 'keyword'").select("review_id"), "review_id")


@query("stream_repeats_kept", "SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(2 AS BIGINT) AS n FROM documents")
def stream_repeats_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that looks for an id in earlier batches only: what repeats inside a batch stays."""
    out = files.scratch(spark, "repeats")
    batch = reviews(spark, sf_dir).select(F.col("review_id").cast("string").alias("review_id"), "product_id")
    sink = pipeline.upsert_sink(f"{out}/table", within_batch=False)
    for k in range(2):
        sink(batch.unionByName(batch), k)
    return spark.read.parquet(f"{out}/table").groupBy("review_id").agg(F.count("*").alias("n"))


@query("stream_last", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def stream_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view: the last 20 events of a kind in the table that a stream has filled, each event once."""
    out = files.scratch(spark, "last")
    live = _live(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    pipeline.run(live, pipeline.upsert_sink(f"{out}/table", key="event_id", product="event_type"), f"{out}/checkpoint", "last").awaitTermination()
    rows = spark.read.parquet(f"{out}/table")
    return R.first_per_group(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "event_type")

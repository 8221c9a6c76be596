"""The live path: events in, scored reviews out, batch by batch without repeats.

Every step before the sink is the same expression that the batch queries use,
so a stream and a batch over the same events agree.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aspectra.functions import fields
from aspectra.functions import sentiment as S
from aspectra.functions import text as T

Sink = Callable[[DataFrame, int], None]
T_ = TypeVar("T_")
EVENT = (
    "product_id string, review_content string, review_text string, reviewContent string, content string, rating string, review_id string, timestamp double"
)
ALIASES = ("review_content", "review_text", "reviewContent", "content")


def source(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A stream with a column ``value``: ``kafka`` where its connector is there, else ``files`` (JSON lines) or ``rate``."""
    if kind == "kafka":
        return spark.readStream.format("kafka").options(**{"startingOffsets": "latest", "failOnDataLoss": "false"} | options).load().select(F.col("value").cast("string").alias("value"))
    if kind == "files":
        path = options.pop("path")
        return spark.readStream.schema("value string").options(**options).text(path)
    return spark.readStream.format("rate").options(**options).load().select(F.to_json(F.struct(F.col("value").cast("string").alias("content"))).alias("value"))


def parse(events: DataFrame) -> DataFrame:
    """Typed reviews of JSON ``value``; what is malformed is kept and marked, ids are made where they lack."""
    d = events.select(F.from_json("value", EVENT).alias("d"), "value").select("d.*", "value")
    known = F.coalesce("product_id", *ALIASES, "rating", "review_id")
    named = d.select(
        F.coalesce("product_id", F.lit("unknown")).alias("product_id"),
        T.first_filled(*[F.col(c) for c in ALIASES], skip_empty=False).alias("original_text"),
        "review_id",
        "rating",
        F.timestamp_seconds("timestamp").alias("event_ts"),
        known.isNull().alias("malformed"),
        "value",
    )
    ids = fields.surrogate_id(F.col("review_id"), F.col("product_id"), F.col("original_text"), F.col("value"))
    return named.withColumn("review_id", ids).drop("value")


def score(parsed: DataFrame, lexicon: S.Lexicon) -> DataFrame:
    """Cleaned text and typed sentiments; no Python on the way."""
    clean = parsed.withColumn("cleaned_text", T.clean_stream(F.col("original_text")))
    return clean.withColumn("sentiment", S.keyword_scores(F.col("cleaned_text"), lexicon))


def spread(df: DataFrame, key: str = "product_id", partitions: int = 4, salts: int = 1) -> DataFrame:
    """``df`` dealt by product before a model sees it; with ``salts`` a product with many rows goes to as many tasks."""
    if salts <= 1:
        return df.repartition(partitions, key)
    return df.repartition(partitions, key, F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(salts)))


def to_messages(df: DataFrame) -> DataFrame:
    """Key and value for a broker: the product and the row as JSON."""
    return df.select(F.col("product_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


OUTPUT = ("product_id", "review_id", "original_text", "cleaned_text", "sentiment_json", "rating", "processed_at")


def outgoing(scored: DataFrame) -> DataFrame:
    """The seven columns that leave the stream, with the sentiments as JSON and the time of the work."""
    return scored.withColumns({"sentiment_json": F.to_json("sentiment"), "processed_at": F.current_timestamp()}).select(*OUTPUT)


BUCKETS = 32  # folders of a table, by product


def _bucket(product: str) -> Column:
    return F.pmod(F.xxhash64(product), F.lit(BUCKETS)).cast("int")


def missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def upsert_sink(path: str, key: str = "review_id", extra: Sink | None = None, product: str = "product_id", within_batch: bool = True) -> Sink:
    """A foreachBatch function that appends rows of unseen ids to a table in folders by batch and by bucket of the product.

    A batch is written under its number; a replay of it overwrites the same
    folder, and ids that other batches hold are left out, so the table holds each
    id once however often a batch is tried.  Only the buckets that the batch
    touches are read for that, and of them only the ids.  Of rows that share an id
    the one with the least hash stays, whichever task has it.  ``within_batch``
    false keeps the repeats of an id inside one batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        if within_batch:
            order = F.xxhash64(F.to_json(F.struct(*batch.columns)))
            fresh = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
        fresh = fresh.withColumn("bucket", _bucket(product))
        try:
            kind = batch.schema[key].dataType.simpleString()
            old = spark.read.schema(f"{key} {kind}, bucket int, batch_id long").parquet(path).where(F.col("batch_id") != batch_id)
            fresh = fresh.join(old.select("bucket", key), ["bucket", key], "left_anti")
        except AnalysisException as error:  # nothing is there before the first batch
            if not missing(error):
                raise
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={batch_id}")
        if extra is not None:  # what was written, so both outputs hold the same rows
            extra(spark.read.schema(fresh.schema).parquet(f"{path}/batch_id={batch_id}").drop("bucket"), batch_id)

    return write


def message_sink(path: str, enabled: bool = True) -> Sink:
    """Messages of each batch under its number, so a replay overwrites them; ``enabled`` false sends none."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if enabled:
            to_messages(batch).write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return write


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string").json(path, pathGlobFilter="*.json")


def relay(events: DataFrame, lexicon: S.Lexicon, path: str, checkpoint: str, name: str = "relay") -> StreamingQuery:
    """Read, score, send: each event in becomes one message out, with the product as its key."""
    return run(score(parse(events), lexicon), message_sink(path), checkpoint, name)


def replay(df: DataFrame, path: str, files: int = 4, limit: int | None = None, seed: int = 7) -> DataFrame:
    """``df`` as a slow stream of JSON lines: shuffled, cut to ``limit`` rows, dealt to files that come one a trigger."""
    own = df if limit is None else df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in df.columns])).limit(limit)
    own.select(F.to_json(F.struct("*")).alias("value")).repartition(files).write.text(path)
    return source(df.sparkSession, "files", path=path, maxFilesPerTrigger="1")


def wait_for(count: Callable[[], int], wanted: int, limit_s: float = 1800.0, poll_s: float = 5.0) -> int:
    """Ask until ``count()`` reaches ``wanted``; beyond the limit a TimeoutError tells how far it came."""
    end = time.monotonic() + limit_s
    while (found := count()) < wanted:
        if time.monotonic() >= end:
            raise TimeoutError(f"{found} of {wanted} after {limit_s} s")
        time.sleep(poll_s)
    return found


def retried(work: Callable[[], T_], times: int = 5, delay_s: float = 5.0) -> T_:
    """The result of ``work``, tried anew after a pause; the last failure is raised."""
    for left in range(times - 1, -1, -1):
        try:
            return work()
        except Exception:  # noqa: BLE001  whatever a connection raises
            if not left:
                raise
            time.sleep(delay_s)
    raise ValueError("times must be one at least")


def chosen_model(spark: SparkSession, path: str, default: str = "keyword") -> str:
    """``model`` of a small JSON file, read anew at every call; anything wrong with it gives the default."""
    try:
        row = spark.read.schema("model string").json(path, multiLine=True).first()
        return (row and row["model"]) or default
    except Exception:  # noqa: BLE001  a broken file must not stop a stream
        return default


def switching(models: dict[str, Callable[[DataFrame], DataFrame]], config: str, sink: Sink, default: str = "keyword") -> Sink:
    """A sink that scores each batch by the model which the config names when the batch starts; an unknown name is the default."""

    def write(batch: DataFrame, batch_id: int) -> None:
        name = chosen_model(batch.sparkSession, config, default)
        sink(models.get(name, models[default])(batch), batch_id)

    return write


def run(stream: DataFrame, sink: Sink, checkpoint: str, name: str = "reviews", every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Start a query; without ``every`` it takes what is there and ends."""
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped on a stream."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    return own.groupBy(F.window(ts, size, slide or size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")

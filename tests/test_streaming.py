"""Streams: restart, replay, batches by count or timeout, batch and stream alike."""

import json
import time

from pyspark.sql import functions as F

from aspectra.plans.scores import LEXICON
from aspectra.streaming import batcher, pipeline


def events(folder, name, rows):
    (folder / name).write_text("\n".join(rows) + "\n")


def test_restart_and_replay(spark, tmp_path):
    source, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    source.mkdir()
    events(source, "a.txt", [json.dumps({"product_id": "p", "content": "tion", "review_id": "1"}), "junk", json.dumps({"product_id": "p", "content": "x"})])

    def go(checkpoint=check):
        live = pipeline.score(pipeline.parse(pipeline.source(spark, "files", path=str(source))), LEXICON)
        pipeline.run(live, pipeline.upsert_sink(table), checkpoint, "t").awaitTermination()
        return spark.read.parquet(table)

    first = go()
    assert first.count() == 3 and first.where("malformed").select("product_id").first()[0] == "unknown"
    assert go().count() == 3
    events(source, "b.txt", [json.dumps({"product_id": "p", "content": "other", "review_id": "1"}), json.dumps({"product_id": "q", "review_id": "2"})])
    assert go().count() == 4
    assert go(str(tmp_path / "lost")).count() == 4  # the checkpoint is gone: everything comes again


def test_sink_replays_one_batch(spark, tmp_path):
    sink = pipeline.upsert_sink(str(tmp_path / "t"))
    batch = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", "2")], "product_id string, review_id string")
    for _ in range(2):
        sink(batch, 0)
    sink(batch.limit(0), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_batcher(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events(source, "a.txt", [f"k{i % 3}" for i in range(210)])
    stream = spark.readStream.text(str(source)).select(F.col("value").alias("key"), F.lit("id").alias("id"))
    query = batcher.batches(stream, timeout_ms=1000).writeStream.outputMode("append").format("memory").queryName("batched").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            rows = spark.sql("SELECT * FROM batched").collect()
            if sum(len(r["ids"]) for r in rows) == 210:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert sum(len(r["ids"]) for r in rows) == 210
    assert all(len(r["ids"]) == 32 for r in rows if r["reason"] == "count") and sum(r["reason"] == "count" for r in rows) == 6


class State:
    """A group's state with a clock that the test turns."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.wait = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.wait = value, None

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.wait = ms


def test_batches_are_timed_from_the_first_arrival(monkeypatch):
    """One id each 10 s never fills a batch; it is flushed 15 s after the first, and batch numbers go on."""
    import pandas as pd

    steps = []

    class Grouped:
        def applyInPandasWithState(self, step, *_):  # noqa: N802
            steps.append(step)

    class Stream:
        def groupBy(self, _):  # noqa: N802
            return Grouped()

    batcher.batches(Stream(), size=3, timeout_ms=15_000)
    state, got = State(), []

    def at(ms, *ids):
        state.now, state.hasTimedOut = ms, not ids
        for pdf in steps[0](("k",), iter([pd.DataFrame({"id": list(ids)})] if ids else []), state):
            got.extend(pdf.itertuples(index=False, name=None))

    at(0, "a")
    assert state.wait == 15_000
    at(10_000, "b")
    assert state.wait == 5_000 and not got
    at(15_000)
    assert got == [("k", 0, "timeout", ["a", "b"])] and state.wait is None
    at(20_000, "c", "d", "e", "f")
    assert got[1:] == [("k", 1, "count", ["c", "d", "e"])] and state.wait == 15_000
    at(36_000, "g")  # the time has passed when the next one comes
    assert got[2:] == [("k", 2, "timeout", ["f", "g"])]


def test_late_rows_are_dropped(spark, tmp_path):
    """A window that the watermark has passed takes nothing more."""
    source = tmp_path / "in"
    source.mkdir()
    events(source, "a.txt", ["2024-01-01 00:10:00", "2024-01-01 05:00:00"])
    out = str(tmp_path / "table")

    def go():
        live = spark.readStream.text(str(source)).select(F.col("value").cast("timestamp").alias("ts"))
        sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch_id={k}")
        pipeline.run(pipeline.windowed(live, "ts", [], "1 hour", late="1 hour"), sink, str(tmp_path / "check"), "late", mode="update").awaitTermination()
        return {str(r["start"])[:13]: r["n"] for r in spark.read.parquet(out).groupBy("start").agg(F.max_by("n", "batch_id").alias("n")).collect()}

    assert go() == {"2024-01-01 00": 1, "2024-01-01 05": 1}
    events(source, "b.txt", ["2024-01-01 00:20:00", "2024-01-01 04:30:00"])
    assert go() == {"2024-01-01 00": 1, "2024-01-01 04": 1, "2024-01-01 05": 1}


def test_waiting_and_retrying():
    import pytest

    left = iter([1, 2, 3])
    assert pipeline.wait_for(lambda: next(left), 3, 5, 0) == 3
    with pytest.raises(TimeoutError, match="1 of 2"):
        pipeline.wait_for(lambda: 1, 2, 0, 0)
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    assert pipeline.retried(flaky, 5, 0) == "done" and len(tries) == 3
    with pytest.raises(OSError, match="never"):
        pipeline.retried(lambda: (_ for _ in ()).throw(OSError("never")), 2, 0)


def test_the_same_row_of_an_id_stays(spark, tmp_path):
    rows = [("p", "1", f"text {k}") for k in range(20)]
    kept = set()
    for k in range(2):
        batch = spark.createDataFrame(rows[:: 1 - 2 * k], "product_id string, review_id string, original_text string").repartition(1 + 3 * k)
        pipeline.upsert_sink(str(tmp_path / str(k)))(batch, 0)
        kept.add(spark.read.parquet(str(tmp_path / str(k))).select("original_text").first()[0])
    assert len(kept) == 1


def test_number_keys_over_batches(spark, tmp_path):
    sink = pipeline.upsert_sink(str(tmp_path / "t"), key="n", product="p")
    for k in range(3):
        sink(spark.range(5 * k, 5 * k + 10).selectExpr("id AS n", "CAST(id % 3 AS STRING) AS p"), k)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["n"] for r in got.collect()) == list(range(20))


def test_kafka_messages(spark):
    df = spark.createDataFrame([("p", "1"), (None, "2")], "product_id string, review_id string")
    got = sorted((r["key"] or "", json.loads(r["value"])["review_id"]) for r in pipeline.to_messages(df).collect())
    assert got == [("", "2"), ("p", "1")]

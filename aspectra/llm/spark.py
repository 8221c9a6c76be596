"""What the operators share about the session: tables, shared folder, labels of a graph."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task joins up by itself.
EDGES = 1 << 20
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) is a temporary folder made
    and set; elsewhere it must be set, for a folder of one machine serves nobody.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="aspectra-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        # a low level: its buffers, outside the heap, are small
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = weakref.ref(out), path
    return out


#: Where :func:`materialize` wrote the tables that are still referred to.
_written: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more: what was made from them is written itself.

    A store that the session's file systems cannot delete from keeps them, as does any frame that is no written table.
    """
    for df in tables:
        known, path = _written.pop(id(df), (None, ""))
        if known is not None and known() is df:
            with contextlib.suppress(Exception):  # tidying up must not fail a job that has its result
                jvm = df.sparkSession.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def _small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes while a table is written; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before is None:  # a version without it
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Have the driver forget finished shuffles now, so that their files go before the next ones come."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    for _ in range(2):  # what the first round frees lets go of the shuffles
        gc.collect()
        if jvm is not None:
            jvm.System.gc()
            time.sleep(0.3)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while (own := f"_{name}_{k}" if k else f"_{name}").lower() in taken:
            k += 1
        taken.add(own.lower())
        out.append(own)
    return out


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at the most; it should be a written table, for it is counted."""
    return F.broadcast(df) if df.count() <= most else df


def about(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows whose hash ``key`` is least: a few more than ``most``, told by a bound on the hash, so that no list is gathered or sorted."""
    n = df.count()
    wanted = most + 10 * int(most**0.5) + 100
    return df if n <= wanted else df.where(key <= F.lit(int(wanted / n * (1 << 64)) - (1 << 63)))


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Column, bool]:
    """A long that rows share only where doc_id and text agree (a null text is empty), and whether it is the doc_id.

    The doc_id, where none is null and each has one text; else a hash of both
    that a second look found without collisions.
    """
    own, whole = F.col(doc_id).cast("long"), F.coalesce(text, F.lit(""))
    mark = lambda seed: F.xxhash64(F.lit(seed), own, whole)
    for key in (own, *map(mark, range(9))):
        seen = docs.select(key.alias("key"), mark(-1).alias("x"), mark(-2).alias("y"))
        seen = seen.groupBy("key").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
        if seen.where("key is null or low_x <> high_x or low_y <> high_y").isEmpty():
            return key, key is own
    raise RuntimeError("no hash tells the rows apart")


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each) of the edges a-b: roots hook to lesser roots, then every label jumps to its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        x, y = label[x], label[y]
        live = x != y
        x, y = x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
    return nodes, nodes[label]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, label)`` per node that has an edge to another.

    ``label`` is the smallest id of the component.  Every task joins up its own
    share of about :data:`EDGES` edges, so a node with a third of all edges is one
    row a task from then on; nodes that several tasks know by different labels are
    edges of a smaller graph, whose labels :func:`_propagated` settles.
    """
    links = materialize(edges.select("a", "b").where("a <> b"), "edges")
    tasks = max(1, -(-links.count() // EDGES))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
        columns = joined_up(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "label"])

    stars = materialize(links.coalesce(tasks).mapInArrow(own, "id long, label long"), "stars")
    discard(links)
    if tasks == 1:
        return stars
    known = materialize(stars.groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high")), "known")
    torn = stars.join(known.where("low <> high").select("id", "low"), "id").where("label <> low").select(F.col("label").alias("a"), F.col("low").alias("b"))
    far = _propagated(torn, max_rounds).select(F.col("id").alias("low"), F.col("label").alias("least"))
    far = broadcast_if_small(materialize(far, "least"))  # a giant component is one key of it
    return known.join(far, "low", "left").select("id", F.coalesce("least", "low").alias("label"))


def _propagated(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Components by rounds over the whole graph.

    A round hands the least label among a node's neighbours to the node and to
    the node it is labelled with, then every label jumps to its own label, so
    rounds grow with the logarithm of the diameter.  Only whether labels changed
    reaches the driver; each round's labels are a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    old = labels
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("far")), "b").groupBy(F.col("a").alias("id")).agg(F.min("far").alias("low"))
        near = materialize(labels.join(seen, "id").select("id", "label", F.least("label", "low").alias("low")), "near-labels")
        hooked = near.select("id", "low").union(near.select(F.col("label").alias("id"), "low")).groupBy("id").agg(F.min("low").alias("low"))
        hooked = materialize(hooked, "hooked")
        jump = hooked.select(F.col("id").alias("low"), F.col("low").alias("jumped"))
        step = labels.join(hooked, "id").join(jump, "low").select("id", F.least("low", "jumped").alias("next"), "label")
        step = materialize(step, "labels")
        discard(old, near, hooked)
        old, labels = step, step.select("id", F.col("next").alias("label"))
        if step.where("label <> next").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

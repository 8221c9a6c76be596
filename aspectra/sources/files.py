"""Readers and writers of files, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": '""', "nullValue": "\\N"}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; only where that is unset in local mode (tests) a temporary folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="aspectra-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, drop_bad: bool = False) -> DataFrame:
    """Quoted, multi-line CSV with a header; ``drop_bad`` leaves malformed lines out."""
    reader = spark.read.options(**CSV, mode="DROPMALFORMED" if drop_bad else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_union(spark: SparkSession, paths: list[str], kind: str = "csv") -> DataFrame:
    """Several files by column name; what one lacks is null."""
    frames = [read_csv(spark, p) if kind == "csv" else spark.read.format(kind).load(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each; a broken file gives no rows."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)


def sniff_header(spark: SparkSession, path: str, marker: str, first: int = 5) -> DataFrame:
    """A CSV whose header is among its first lines: the line with a cell equal to ``marker``.

    Only ``first`` lines come to the driver; rows above the header are dropped by
    their place in the file.
    """
    raw = spark.read.options(quote='"', escape='"').csv(path).withColumns({"_at": F.monotonically_increasing_id()})
    names = [c for c in raw.columns if c != "_at"]
    for row in raw.orderBy("_at").limit(first).collect():
        if marker in [str(row[c]).strip() for c in names]:
            kept = [(c, str(row[c]).strip()) for c in names if row[c] is not None]
            return raw.where(F.col("_at") > row["_at"]).select(*[F.col(c).alias(n) for c, n in kept])
    raise ValueError(f"no line with {marker!r} among the first {first}")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(product_id, review_count, last_modified) of a table partitioned by product, newest first."""
    df = spark.read.parquet(folder)
    return df.groupBy("product_id").agg(F.count("*").alias("review_count"), F.max("_metadata.file_modification_time").alias("last_modified")).orderBy(F.desc("last_modified"), "product_id")


def shown_time(moment: Column) -> Column:
    """A time as people read it, in the session's zone."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def heads(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of each file."""
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return df.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()}).withColumn("_n", place).where(F.col("_n") <= n).drop("_file", "_at", "_n")


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list file: straight or curly quotes go, lines without a URL are keywords and are left out."""
    url = F.regexp_extract("value", r"(https?://[^\s\"'“”‘’]+)", 1)
    return spark.read.text(path).select(url.alias("url")).where("url <> ''")

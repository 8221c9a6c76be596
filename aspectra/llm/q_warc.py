"""op5: WARC archives written, read back and summed up by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .spark import table


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(warc.with_roles(table(spark, sf_dir, "pages")))
    chunks = warc.read_chunks(manifest).where("last")
    return chunks.select(
        "page_id",
        F.col("length_so_far").alias("payload_bytes"),
        F.col("sha1_so_far").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


QUERIES = {"op5_warc_chunks": op5_warc_chunks}
ORACLE_SQL = {
    "op5_warc_chunks": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM f"""
}

"""WARC archives as a chunked record table.

Writing: a payload becomes rows (record id, chunk number) of :data:`CHUNK` bytes
at most before anything is written; a task streams these rows into one archive,
each record a gzip member of its own, and holds one chunk at a time.  The digest
that a record's header states is held against the digest that runs along with
its chunks.  An archive's name holds a fresh id and counts only once the
manifest that names it is written, so a task that is lost and run again leaves
at most an unread file.

Reading: a record comes back as rows (record id, chunk number), each with the
length and the SHA-1 so far; no payload is ever held whole, whatever its size.

Of equal payloads the one with the smallest id is stored (response); the others
are revisits whose HTTP header still gives the length.  A null payload counts
as empty.  Of rows that repeat that smallest id one is the response and the
others revisit it.  Rows without id revisit the smallest id of their payload;
where none has an id, each of them is a response.  Every record has an id of
its own, whatever repeats.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from gzip import GzipFile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import broadcast_if_small, materialize, shared_dir

CHUNK = 1 << 16
MANIFEST_SCHEMA = "path string, records long"
ROW_SCHEMA = ("page_id", "url", "digest", "length", "refers_to", "again", "chunk", "data")
CHUNK_SCHEMA = (
    "page_id long, record_id string, record_type string, url string, refers_to long, chunk int, last boolean, "
    "length_so_far long, sha1_so_far string, payload_length long, data binary"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path  # one store, two names of it
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(url: str | None) -> str:
    """A header value on one line."""
    return " ".join((url or "").split())


def _record_id(page_id: int | None, digest: str, again: bool) -> str:
    """A name that no other record has; the response of an id and payload has the one without a suffix."""
    plain = f"urn:page:{'none' if page_id is None else page_id}:{digest}"
    return f"{plain}:{uuid.uuid4().hex}" if again or page_id is None else plain


def _head(row: dict) -> bytes:
    """Everything of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['length']}\r\n\r\n".encode()
    stored = row["refers_to"] is None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if stored else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(row['page_id'], row['digest'], row['again'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(row['url'])}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
    ]
    if not stored:
        lines += [f"WARC-Refers-To: <{_record_id(row['refers_to'], row['digest'], False)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (row['length'] if stored else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest (hex), length, ``refers_to`` (null for a response) and ``again`` (not the first of its id and payload). Payloads move once, by page_id."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    counted = own.groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    counted = materialize(counted, "payloads")
    named = counted.where("page_id is not null")
    first = named.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("pages"))
    shared = broadcast_if_small(materialize(first.where("pages > 1").select("digest", "least"), "shared-payloads"))
    later = named.join(shared, "digest").where("page_id > least").select("page_id", "digest", F.col("least").alias("refers_to"))
    out = own.where("page_id is not null").join(later, ["page_id", "digest"], "left").withColumn("again", F.lit(False))
    if not named.where("n > 1").isEmpty():  # copies of one id and payload are told apart
        repeats = named.where("n > 1").select("page_id", "digest")
        numbered = out.join(repeats, ["page_id", "digest"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
        again = F.col("_n") > 1
        refers = F.when(again, F.coalesce("refers_to", "page_id")).otherwise(F.col("refers_to"))
        out = out.join(repeats, ["page_id", "digest"], "left_anti").unionByName(numbered.withColumns({"refers_to": refers, "again": again}).drop("_n"))
    if not counted.where("page_id is null").isEmpty():
        nameless = own.where("page_id is null").join(first.select("digest", F.col("least").alias("refers_to")), "digest", "left")
        out = out.unionByName(nameless.withColumn("again", F.lit(False)))
    return out.select("page_id", "url", "payload", F.hex("digest").alias("digest"), F.length("payload").cast("long").alias("length"), "refers_to", "again")


def chunked(rows: DataFrame) -> DataFrame:
    """A row a chunk, in order, for the rows of :func:`with_roles`; a revisit has one, without bytes."""
    stored = F.col("refers_to").isNull()
    last = F.when(stored, F.greatest(F.ceil(F.col("length") / CHUNK).cast("int") - 1, F.lit(0))).otherwise(0)
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(stored, F.substring(F.col("payload"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    return cut.withColumn("data", data).select(*ROW_SCHEMA)


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of :func:`with_roles`; returns the manifest of the archives that count."""
    folder = folder or f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n = None, "", 0
        packer, digest, row, done = None, None, {}, 0
        try:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ROW_SCHEMA[:-1]]
                for *values, data in zip(*columns, batch.column("data"), strict=True):
                    new = dict(zip(ROW_SCHEMA, values, strict=False))
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        store, at = _opened(path)
                        store.create_dir(at.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(at, compression=None)
                    if new["chunk"] == 0:
                        row, done, digest, packer = new | {"digest": base32_sha1(bytes.fromhex(new["digest"]))}, 0, hashlib.sha1(), zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(packer.compress(_head(row)))
                    piece = memoryview(data.as_buffer())
                    digest.update(piece)
                    done += len(piece)
                    if len(piece):
                        out.write(packer.compress(piece))
                    if row["refers_to"] is not None or done == row["length"]:
                        if row["refers_to"] is None and base32_sha1(digest.digest()) != row["digest"]:
                            raise ValueError(f"the chunks of page {row['page_id']} do not have the digest of its payload")
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return materialize(chunked(rows).mapInArrow(write, MANIFEST_SCHEMA), "warc-manifest")


def _headers(source: GzipFile) -> dict[str, str]:
    found = {}
    while (line := source.readline().strip()):
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return None if page == "none" else int(page)


def chunks_of(source: GzipFile) -> Iterator[dict]:
    """The chunk rows of one archive, in order."""
    while (line := source.readline()):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one must start")
        head = _headers(source)
        source.readline()  # the HTTP status
        http = _headers(source)
        ref = head.get("warc-refers-to")
        row = {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": head["warc-type"],
            "url": head.get("warc-target-uri"),
            "refers_to": _page_of(ref.strip("<>")) if ref else None,
            "payload_length": int(http["content-length"]),
        }
        row["page_id"] = _page_of(row["record_id"])
        if row["record_type"] == "revisit":
            yield row | {"chunk": 0, "last": True, "length_so_far": row["payload_length"], "sha1_so_far": head["warc-payload-digest"].removeprefix("sha1:"), "data": b""}
        else:
            digest, done, k = hashlib.sha1(), 0, 0
            while done < row["payload_length"] or not k:
                data = source.read(min(CHUNK, row["payload_length"] - done))
                if not data and row["payload_length"]:
                    raise ValueError("the archive ends within a record")
                digest.update(data)
                done += len(data)
                yield row | {"chunk": k, "last": done == row["payload_length"], "length_so_far": done, "sha1_so_far": base32_sha1(digest.copy().digest()), "data": data}
                k += 1


def read_chunks(manifest: DataFrame, data: bool = True) -> DataFrame:
    """The record table of the archives: one row a chunk; ``data`` false leaves the bytes out."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def flushed(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "chunk": pa.int32(), "last": pa.bool_(), "length_so_far": pa.int64(), "payload_length": pa.int64(), "data": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _opened(path)
                with store.open_input_stream(at, compression=None) as raw, GzipFile(fileobj=raw) as source:
                    rows: list[dict] = []
                    for row in chunks_of(source):
                        rows.append(row if data else row | {"data": None})
                        if len(rows) >= (64 if data else 4096):
                            yield flushed(rows)
                            rows = []
                    if rows:
                        yield flushed(rows)

    many = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return manifest.select("path").repartition(many, "path").mapInArrow(read, CHUNK_SCHEMA)

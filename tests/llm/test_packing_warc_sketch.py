"""op3, op5 and op10 against brute force; edge cases of each."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.llm import packing, q_packing, q_sketches, q_warc, sketches, warc

ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \t\n", None),
    (4, "one two", "x"),
    (5, "Ünï 'tis we'd İstanbul ΣΑΣ <|endoftext|> 漢字 \x1c a b 3²", "x"),
    (6, "word " * 9000, "x"),
    (7, "word " * 9000, "x"),
    (7, "word " * 9000, "x"),
]


def odd(spark, schema="doc_id long, text string, fingerprint string"):
    return spark.createDataFrame(ODD, schema)


def shingles(text):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op3(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in q_sketches.op3_fingerprints(spark, sf).collect()}
    assert set(got) == set(docs)
    wrong = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n, r = docs[a], len(docs[a]), got[a]
        edited = t[: n - n // 3] + docs[b][: n // 3]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        wrong += [abs(r["near_edited"] - jaccard(t, edited)), abs(r["near_next"] - jaccard(t, docs[b]))]
        assert r["fingerprint"] == got[a]["fingerprint"] and len(sketches.from_text(r["fingerprint"])) == min(sketches.K, len(shingles(t)))
    assert max(wrong) < 0.15 and sum(wrong) / len(wrong) < 0.02


def test_op3_odd(spark):
    got = sketches.against_neighbours(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert {r["fingerprint"] for r in got if r["doc_id"] == 6} == {r["fingerprint"] for r in got if r["doc_id"] == 7}
    assert sketches.against_neighbours(odd(spark).limit(0)).count() == 0
    one = sketches.against_neighbours(odd(spark).where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_op3_without_ids(spark):
    """Rows without doc_id come after all others; the text orders rows of one id; an own column keeps out of the way."""
    rows = [(None, "b b b b b c", True), (9, "x1 x2 x3 x4 x5 x6", False), (None, "a a a a a a a", True), (-3, "y1 y2 y3 y4 y5 y6", False)]
    got = sketches.against_neighbours(spark.createDataFrame(rows, "doc_id long, text string, given boolean")).collect()
    order = ["x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6", "a a a a a a a", "b b b b b c"]
    want = set()
    for d, a, b in zip((9, -3, None, None), order, order[1:] + order[:1], strict=True):
        n = len(a)
        want.add((d, hashlib.sha256((a[: n - n // 3] + b[: n // 3]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in got} == want and len(got) == 4


def test_sketch_merge(spark):
    random.seed(1)
    words = [str(random.random()) for _ in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    import pyarrow as pa

    x, y = sketches.sketches(pa.array([a, b]))
    assert abs(sketches.likeness(x, y) - 0.5) < 0.1 and abs(sketches.containment(x, y) - 2 / 3) < 0.15
    assert abs(sketches.distinct(x) / 2996 - 1) < 0.2
    df = spark.createDataFrame([(i % 2, a if i % 3 else b) for i in range(6)], "k int, text string")
    total = sketches.merged(sketches.fingerprint(df), ["k"]).collect()
    assert {r["fingerprint"] for r in total} == {sketches.to_text(sketches.merge(x, y))}


def test_op5(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    got = {r["page_id"]: r for r in q_warc.op5_warc_chunks(spark, sf).collect()}
    assert set(got) == set(pages)
    for p, html in pages.items():
        r = got[p]
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html] == p else ("revisit", first[html]))


def test_warc_chunks(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 40_000
    rows = [(1, "http://a\r\nb", big), (2, None, None), (3, "u", ""), (4, "u", big), (4, "u", big)]
    manifest = warc.write_archives(warc.with_roles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))
    chunks = warc.read_chunks(manifest).collect()
    own = sorted((r["chunk"], bytes(r["data"])) for r in chunks if r["page_id"] == 1)
    assert len(own) > 5 and b"".join(d for _, d in own).decode() == big
    last = sorted((r["page_id"], r["record_type"], r["refers_to"], r["length_so_far"]) for r in chunks if r["last"])
    n = len(big.encode())
    assert last == [(1, "response", None, n), (2, "response", None, 0), (3, "revisit", 2, 0), (4, "revisit", 1, n), (4, "revisit", 1, n)]
    assert len({r["record_id"] for r in chunks}) == len(rows)
    empty = warc.write_archives(warc.with_roles(spark.createDataFrame([], "page_id long, url string, html string")))
    assert warc.read_chunks(empty).count() == 0


def test_warc_repeats_and_missing_ids(spark):
    """One response a payload, whatever repeats; records without an id are kept; every record has its own name."""
    rows = [(5, "u", "same"), (5, "v", "same"), (5, "u", "same"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (5, "u", "other"), (None, "n", "alone"), (None, "n", "alone"), (None, None, None)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    chunks = warc.read_chunks(warc.write_archives(warc.with_roles(df))).collect()
    assert len(chunks) == len(rows) == len({r["record_id"] for r in chunks}) and all(r["last"] for r in chunks)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["length_so_far"]) for r in chunks)
    want = [("5", "response", "None", 4), *[("5", "revisit", "5", 4)] * 2, *[("7", "revisit", "5", 4)] * 2, ("None", "revisit", "5", 4), ("5", "response", "None", 5)]
    assert got == sorted([*want, *[("None", "response", "None", 5)] * 2, ("None", "response", "None", 0)])


def test_warc_chunks_are_checked(spark, monkeypatch):
    """A digest that the chunks do not have stops the writing."""
    roles = warc.with_roles(spark.createDataFrame([(1, "u", "x" * 200_000)], "page_id long, url string, html string"))
    assert warc.chunked(roles).count() == 4 and warc.chunked(roles).agg(F.sum(F.length("data"))).first()[0] == 200_000
    with pytest.raises(Exception, match="do not have the digest"):
        warc.write_archives(roles.withColumn("digest", F.lit("00" * 20)))


def packed_well(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q_packing.tokenizer_path())
    want = []
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want.append((d, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 4096
    total = sum(r["length"] for r in rows)
    return len(at), -(-total // 4096)


def test_op10(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = packed_well(q_packing.op10_pattern_packing(spark, sf).collect(), docs)
    assert used <= least * 1.03 + 1


def test_pack_odd(spark):
    used, least = packed_well(packing.pack(odd(spark), q_packing.tokenizer_path()).collect(), [(d, t) for d, t, _ in ODD])
    assert used <= least + 1
    assert packing.pack(odd(spark).limit(0), q_packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6.3, 1, 20_000).astype(int) + 1)
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    runs, n = packing.plan(hist)
    fill, where = np.zeros(n, int), {}
    for length, rank, count, first, offset in runs:
        for k in range(count):
            assert (length, rank + k) not in where
            where[length, rank + k] = (first + k, offset)
            fill[first + k] += length
    assert len(where) == len(lengths) and fill.max() <= 4096
    assert n <= 1.002 * -(-lengths.sum() // 4096) + 1

"""op6 against brute force: patterns by re, entropy of each window counted anew."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from aspectra.llm import secrets as S


def brute(text):
    t = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    added = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        if any(re.search(p, m[0]) for p in S.ALLOWED):
            continue
        kind = "entropy_hex" if re.fullmatch("[0-9a-fA-F]+", m[0]) else "entropy_base64"
        hit = [i for i in range(len(m[0]) - 19) if sum(S.clog(c) for c in Counter(m[0][i : i + 20]).values()) <= S.most(kind)]
        if hit:
            added.append((m.start() + hit[0], S.KINDS.index(kind), m.start() + hit[-1] + 20))
    added = [a for a in added if not any(b[0] <= a[0] and a[2] <= b[2] for b in base)]
    return sorted(base), sorted(base + added)


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = S.scan_secrets(df.withColumn("secrets", F.lit("a column of that name"))).orderBy("i").collect()
    return [(sorted(tuple(s) for s in r["secrets"]["base"]), sorted(tuple(s) for s in [*r["secrets"]["base"], *r["secrets"]["added"]])) for r in found]


def test_cases(spark):
    rng = random.Random(0)
    pools = ["0123456789abcdef", "ABCDEFabcdef0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "aab", "A0"]
    texts = [
        None, "", " ", "é password = 'hunter22' ü", "PASSWORD:short", "api_key=abcdefgh token:  \"12345678\"", "AKIA" + "A" * 11, "AKIA" + "B" * 12, "f" * 31, "f" * 32,
        "3f2504e0-4f89-41d3-9a0c-0305e82c3301", "an-ordinary-long-hyphenated-word-chain", "EXAMPLEabcdefGHIJKL0123456789xyz", "12345678901234567890123", "x" * 50_000 + " secret=abcdefgh",
    ]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            pool = rng.choice(pools)
            parts.append(rng.choice(["token=", "Secret: ", "AKIA", "", "id-", "é"]) + "".join(rng.choice(pool) for _ in range(rng.randrange(5, 60))))
        texts.append(rng.choice([" ", "\n", "."]).join(parts))
    assert scan(spark, texts) == [brute(t) for t in texts]
    assert any(len(b) > len(a) for a, b in map(brute, texts))
    texts = [t or "" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    spans = F.array_sort(F.concat("secrets.base", "secrets.added"))
    got = S.scan_secrets(df).select("i", S.redact(F.col("text"), spans).alias("out")).orderBy("i").collect()
    assert [r["out"] for r in got] == [masked(t) for t in texts]


def masked(text):
    """The text with its spans, joined where they touch, replaced one after the other."""
    at, out = 0, []
    for a, _, b in brute(text)[1]:
        if a > at or at == 0:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_long(spark):
    """Very long candidates and very many matches end soon and give the same spans."""
    rng = random.Random(1)
    base64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = [
        "a-" * 200_000,
        "".join(rng.choice(base64) for _ in range(1_000_000)),
        " é ".join(f"token=abcdefgh{i}" for i in range(100_000)),
        " ".join("".join(rng.choice(base64) for _ in range(30)) + f" secret=x{i:08d}" for i in range(10_000)),
        "ab" * 3 + "Ab-12345-" * 50_000 + "!",
    ]
    began = time.monotonic()
    assert scan(spark, texts) == [brute(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    spans = F.array_sort(F.concat("secrets.base", "secrets.added"))
    got = S.scan_secrets(df).select("i", S.redact(F.col("text"), spans).alias("out")).orderBy("i").collect()
    assert [r["out"] for r in got] == [masked(t) for t in texts]
    assert time.monotonic() - began < 150


def test_empty_table_and_copies(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh")], "doc_id long, text string")
    assert len({str(r["secrets"]) for r in S.scan_secrets(df).collect()}) == 1
    assert S.scan_secrets(df.limit(0)).count() == 0


def test_entropy_is_the_window_entropy():
    for kind, (_, window, bits) in S.CLASSES.items():
        flat = math.log2(window) - S.most(kind) / S.SCALE / window
        assert abs(flat - bits) < 1e-6

import math
import zlib

import numpy as np
import pyarrow as pa

from aspectra.llm import language, q_language


def test_gradients():
    """Backpropagation through time against central differences."""
    rng = np.random.default_rng(0)
    net = language.BiGru(3, hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 5, (7, 4))
    y, w = np.array([0, 1, 2, 1]), rng.random((7, 4)) + 0.1
    _, g = net.gradients(x, y, w)
    for name, grad in g.items():
        for _ in range(5):
            at = tuple(rng.integers(0, min(n, 5)) for n in grad.shape)
            v, losses = net.p[name][at], []
            for step in (1e-3, -1e-3):
                net.p[name][at] = v + step
                losses.append(net.gradients(x, y, w)[0])
            net.p[name][at] = v
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[at]) < 2e-3, name


def by_hand(net, text):
    """Mean probabilities over letter positions: one byte after the other, in plain Python, each window from zero states."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    n, raw, sums, count = net.hidden, text.encode(), None, 0
    for low in range(0, len(raw), language.WINDOW):
        part = list(raw[low : low + language.WINDOW])
        part += [256] * (language.WINDOW - len(part))
        states = {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            e, u, h = net.p[f"E{d}"].tolist(), net.p[f"U{d}"].tolist(), [0.0] * n
            for t in order:
                g = e[part[t]]
                z = [sig(g[i] + sum(h[j] * u[j][i] for j in range(n))) for i in range(n)]
                r = [sig(g[n + i] + sum(h[j] * u[j][n + i] for j in range(n))) for i in range(n)]
                c = [math.tanh(g[2 * n + i] + sum(r[j] * h[j] * u[j][2 * n + i] for j in range(n))) for i in range(n)]
                h = [h[i] + z[i] * (c[i] - h[i]) for i in range(n)]
                states[d, t] = h
        for t, sign in enumerate(part):
            if sign < 256 and (sign >= 128 or chr(sign).isalpha()):
                both = states["f", t] + states["b", t]
                s = [sum(both[i] * float(net.p["W"][i, k]) for i in range(2 * n)) + float(net.p["c"][k]) for k in range(len(net.p["c"]))]
                e = [math.exp(v - max(s)) for v in s]
                sums = [a + b / sum(e) for a, b in zip(sums or [0.0] * len(e), e)]
                count += 1
    return [v / count for v in sums] if count else [0.0] * len(net.p["c"])


def test_forward_against_plain_python():
    net = language.BiGru(3, seed=4)
    texts = ["the cat", "é", "", "12 ?", "Ein sehr langer Satz, der über mehr als ein Fenster reicht: " * 3, "a"]
    got = language.pooled(net, pa.array(texts), 3)
    assert np.allclose(got, [by_hand(net, t) for t in texts], atol=1e-5)


def test_training_reads_whole_texts(spark):
    """What tells two languages apart stands beyond the first windows only."""
    rows = [("1234 " * 200 + f"alpha beta gamma {i} " * 20, "aa") for i in range(60)] + [("1234 " * 200 + f"zulu yankee xray {i} " * 20, "zz") for i in range(60)]
    net, langs = language.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "alpha gamma beta", "kept"), (2, "xray zulu", "kept")], "doc_id long, text string, score string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, net, langs).collect()} == {1: "aa", 2: "zz"}


def test_op7(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q_language.op7_byte_gru(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(lang) and len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd(spark):
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the cat and the dog " * 5000), (5, "é"), (5, "é"), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net, langs = language.train(spark.createDataFrame([("the dog sat", "en"), ("der Hund saß", "de"), ("x", None)], "text string, lang string"))
    got = language.predict(df, net, langs).collect()
    assert len(got) == 7 and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert len({tuple(r) for r in got if r["doc_id"] == 5}) == 1
    none = language.predict(df, *language.train(df.selectExpr("text", "CAST(NULL AS string) AS lang"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language.predict(df.limit(0), net, langs).count() == 0


def test_every_language_is_drawn(spark, monkeypatch):
    """A rare language, and copies that would fill the sample: each language has its share, equal texts count once."""
    monkeypatch.setattr(language, "LEAST", 5)
    rows = [(f"the dog number {i} sat", "en") for i in range(3000)] + [(f"hunden nummer {i} satt", "sv") for i in range(3)]
    common = spark.createDataFrame(rows, "text string, lang string")
    hashes = {r["text"]: r["h"] for r in common.selectExpr("text", "xxhash64(text, 0) AS h").collect()}
    small = min((t for t, g in rows if g == "en"), key=hashes.get)
    docs = common.union(spark.createDataFrame([(small, "en")] * 200, "text string, lang string"))
    got = language.chosen(docs, sample=40)
    assert len({(r["lang"], r["key"]) for r in got}) == len(got)
    want = sorted(hashes[t] for t, g in rows if g == "en")[:37]
    assert sorted(r["key"] for r in got if r["lang"] == "en") == want
    assert sum(r["lang"] == "sv" for r in got) == 3
    assert language.train(docs, sample=40)[1] == ["en", "sv"]
    assert language.share_out({"a": 10, "b": 100, "c": 100}, 70) == 30 and language.share_out({"a": 2}, 70) == 5

"""Scorers behind one protocol, naive Bayes, and a hidden Markov tagger."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions import sentiment as S


class Scorer(Protocol):
    """Legacy codes (1, -1, 0, 2) by aspect for each text of a batch."""

    aspects: tuple[str, ...]

    def predict(self, texts: list[str]) -> list[list[int]]: ...


class KeywordScorer:
    """The keyword rules in Python, for pipelines that swap models."""

    def __init__(self, lexicon: S.Lexicon, aspects: tuple[str, ...] = S.ASPECTS) -> None:
        self.lexicon, self.aspects = lexicon, aspects

    def predict(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            low, row = text.lower(), []
            for a in self.aspects:
                said = {p for x, p, w in self.lexicon if x == a and w in low}
                row.append(2 if not said else 0 if {"POS", "NEG"} <= said else 1 if "POS" in said else -1 if "NEG" in said else 0)
            out.append(row)
        return out


class ReplyScorer:
    """A back-end that answers one text at a time with a reply that holds JSON, e.g. ``{"aspect": "POS"}``, among other words."""

    def __init__(self, reply: Callable[[str], str], aspects: tuple[str, ...] = S.ASPECTS) -> None:
        self.reply, self.aspects = reply, aspects

    def predict(self, texts: list[str]) -> list[list[int]]:
        codes = {"POS": 1, "NEG": -1, "NEU": 0}
        out = []
        for text in texts:
            said = self.reply(text)
            low, high = said.find("{"), said.rfind("}")
            flat = json.loads(said[low : high + 1]) if 0 <= low < high else {}
            out.append([codes.get(flat.get(a), 2) for a in self.aspects])
        return out


def preferred(*makes: Callable[[], Scorer]) -> Callable[[], Scorer]:
    """The first scorer that can be made; where none can, one that mentions no aspect, so a missing model stops nothing."""

    def make() -> Scorer:
        for one in makes:
            try:
                return one()
            except Exception:  # noqa: BLE001, S112  a model may be missing or broken in any way
                continue
        return KeywordScorer(())

    return make


FORMATS = ("legacy", "multipolarity", "both")


def scored_by(make: Callable[[], Scorer], text: Column, batch: int = 32) -> Column:
    """struct<codes map<aspect, code>, error> by a scorer made once a worker; never evaluated twice for one output.

    A batch that fails gives every row of it the empty prediction, no aspect
    mentioned, and the failure's text.
    """

    @F.pandas_udf("codes map<string,int>, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make()
        empty = dict.fromkeys(scorer.aspects, 2)
        for part in parts:
            out: list[tuple[dict, str | None]] = []
            for k in range(0, len(part), batch):
                texts = part.iloc[k : k + batch].fillna("").tolist()
                try:
                    out += [(dict(zip(scorer.aspects, row, strict=True)), None) for row in scorer.predict(texts)]
                except Exception as error:  # noqa: BLE001  a model may fail in any way; the rows stay
                    out += [(empty, f"{type(error).__name__}: {error}")] * len(texts)
            yield pd.DataFrame(out, columns=["codes", "error"])

    return run.asNondeterministic()(text)


def predictions(df: DataFrame, make: Callable[[], Scorer], text: str, output: str = "both", batch: int = 32) -> DataFrame:
    """``df`` with ``codes`` (legacy), ``cells`` (multipolarity) or both, and ``error``."""
    if output not in FORMATS:
        raise ValueError(f"{output!r} is none of {FORMATS}")
    found = df.withColumn("_found", scored_by(make, F.col(text), batch))
    made = {"codes": F.col("_found.codes"), "cells": F.transform_values("_found.codes", lambda _, c: S.legacy_cell(c))}
    chosen = {"legacy": ["codes"], "multipolarity": ["cells"], "both": ["codes", "cells"]}[output]
    return found.select(*df.columns, *[made[c].alias(c) for c in chosen], F.col("_found.error").alias("error"))


def naive_bayes(train: DataFrame, test: DataFrame, text: str, label: str, vocabulary: int = 1 << 18) -> DataFrame:
    """Multinomial naive Bayes over word counts; everything is fitted on ``train`` only.

    ``vocabulary`` is the model's size, a parameter as in any count model; only words of two documents or more are in it.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+")
    counts = CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocabulary, minDF=2)
    model = Pipeline(stages=[words, counts, NaiveBayes(featuresCol="_counts", labelCol=label, predictionCol="prediction")]).fit(train)
    return model.transform(test).drop("_words", "_counts", "rawPrediction", "probability")


def viterbi(log_start: np.ndarray, log_move: np.ndarray, log_seen: np.ndarray) -> list[int]:
    """The likeliest states of one sequence; ``log_seen`` has a row a position."""
    best, back = log_start + log_seen[0], []
    for row in log_seen[1:]:
        step = best[:, None] + log_move
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def tag(words: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``words(sent, pos, word, tag)`` with ``predicted``: counts in DataFrames, one decode a sentence.

    Only tag by tag counts reach the driver; the log probabilities of a word come
    along with its rows.
    """
    low = words.withColumn("word", F.lower("word"))
    tags = sorted(r["tag"] for r in low.select("tag").distinct().collect())
    n = len(tags)
    place = {t: k for k, t in enumerate(tags)}
    move = np.full((n, n), alpha)
    nxt = F.lead("tag").over(Window.partitionBy("sent").orderBy("pos"))
    for r in low.withColumn("nxt", nxt).where("nxt IS NOT NULL").groupBy("tag", "nxt").count().collect():
        move[place[r["tag"]], place[r["nxt"]]] += r["count"]
    start, total = np.full(n, alpha), np.zeros(n)
    for r in low.groupBy("tag").agg(F.count_if(F.col("pos") == 0).alias("first"), F.count("*").alias("all")).collect():
        start[place[r["tag"]]] += r["first"]
        total[place[r["tag"]]] = r["all"]
    size = low.select("word").distinct().count()
    log_move, log_start = np.log(move / move.sum(1, keepdims=True)), np.log(start / start.sum())
    seen = low.groupBy("word").agg(*[F.count_if(F.col("tag") == t).alias(f"c{k}") for k, t in enumerate(tags)])
    logs = [F.log((F.col(f"c{k}") + F.lit(alpha)) / F.lit(float(total[k] + alpha * size))) for k in range(n)]
    rows = words.select("sent", "pos", "tag", F.lower("word").alias("word")).join(seen.select("word", F.array(*logs).alias("logs")), "word")

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        path = viterbi(log_start, log_move, np.stack(pdf["logs"].to_list()))
        return pd.DataFrame({"sent": pdf["sent"], "pos": pdf["pos"], "tag": pdf["tag"], "predicted": [tags[k] for k in path]})

    return rows.groupBy("sent").applyInPandas(decode, "sent string, pos int, tag string, predicted string")


def svd(df: DataFrame, key: str, text: str, k: int, vocabulary: int) -> DataFrame:
    """(key, features): count vectors times the ``k`` largest right singular vectors.

    The Gram matrix, ``vocabulary`` squared, is summed up over the partitions; its
    eigenvectors give the projection, which the rows are multiplied with where they are.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+")
    counted = Pipeline(stages=[words, CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocabulary, minDF=2)]).fit(df).transform(df)
    rows = counted.select(F.col(key), vector_to_array("_counts").alias("_row"))

    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in parts:
            x = np.array(pdf["_row"].to_list())
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "g": list(total)})

    sums = rows.select("_row").mapInPandas(gram, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    cells = sums.toPandas()  # vocabulary squared, a parameter
    if cells.empty:
        return df.select(key, F.array().cast("array<double>").alias("features")).limit(0)
    n = int(cells["i"].max()) + 1
    matrix = np.zeros((n, n))
    matrix[cells["i"], cells["j"]] = cells["v"]
    basis = np.linalg.eigh(matrix)[1][:, ::-1][:, :k]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])  # the largest entry of each is positive

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(x.to_list()) @ basis))

    return rows.select(key, project("_row").alias("features"))

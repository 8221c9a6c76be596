"""Mixing sources to target weights: raking of token weights, then calibrated sampling.

Documents are summed up to cells (source, language, topic).  Iterative
proportional fitting scales the cells' token weights, one margin after the
other, to target tokens, with no weight above the tokens a cell has: a cell at
that bound is held there and the other cells of its margin value are scaled to
what is left.  Rounds go on until every margin holds to ``TOLERANCE`` of all
tokens, ``ROUNDS`` of them at most.  A cell's rate is weight over tokens; a
document is drawn when a fixed uniform number of its doc_id lies below its
cell's rate, so the drawn documents have the target margins in expectation.

Target shares of sources grow with ``POWER`` of their tokens; languages and
topics have given shares, and values that no share names split what is left by
their tokens.  A value whose target exceeds the tokens it has keeps all of them
and the others share the rest, so each margin can be met by itself; where the
three cannot be met together, the last margin of a round holds and
:func:`residual` tells what the others miss.

Only cells are summed by margin: a source with a third of all rows is a handful
of cells.  Up to ``MOST_CELLS`` cells are fitted in one numpy table; more are
fitted by the same steps as a DataFrame.  Documents meet the rates by a
broadcast whose size is checked, or else by salted cells.

Null keys form their own cell value ''; a null or empty text has no tokens and
counts one; rows without doc_id share one number; repeated rows are drawn alike.
Columns of any name stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import discard, materialize, unused

MARGINS = ("source", "lang", "topic")
ROUNDS = 100
TOLERANCE = 1e-13
STEP = 4.0  # the most that one step scales a weight by
DIGITS = 7  # of a rate
POWER = 0.7
LANG_SHARES = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12}
TOPIC_SHARES = {"prose": 0.9, "tabular": 0.03}
SHARES = {"source": None, "lang": LANG_SHARES, "topic": TOPIC_SHARES}
MOST_CELLS = 200_000
BROADCAST_CELLS = 50_000
SALTS = 64
BUDGET = 0.8  # expected tokens, as a share of all tokens
#: topic: pattern that a text of it holds; the first that fits, else prose.
TOPICS = (("tabular", r" \| "), ("contact", r"[A-Za-z0-9._+-]@[A-Za-z0-9-]+\.[A-Za-z]"), ("licensed", r"[Ll]icen[cs]e|LICEN[CS]E|[Cc]opyright"))
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    chosen = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        chosen = F.when(text.rlike(pattern), name).otherwise(chosen)
    return chosen


def n_tokens(text: Column) -> Column:
    """Words between white space; one at least."""
    bare = F.trim(F.regexp_replace(text, GAP, " "))
    return (F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that only depends on the id: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def described(docs: DataFrame, topic_of: Column | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with their source, language, topic and tokens, and the names of these four columns.

    ``topic_of``: the topic that any classifier has found; by default that of :data:`TOPICS`.
    """
    names = unused(docs, *MARGINS, "tokens")
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = topic(text) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit(""))
    values = (F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit("")), chosen, n_tokens(text))
    return docs.withColumns(dict(zip(names, values, strict=True))), names


def shares(values: list[str], n: np.ndarray, given: dict[str, float] | None) -> np.ndarray:
    """The target share of each value of a margin, which has ``n`` tokens."""
    if given is None:
        raw = n**POWER
    else:
        named = np.array([given.get(v, np.nan) for v in values])
        other = np.isnan(named)
        raw = np.where(other, (1 - sum(given.values())) * n / max(1.0, n[other].sum()), named)
    return raw / raw.sum()


def reachable(n: np.ndarray, share: np.ndarray, tokens: float) -> np.ndarray:
    """Target tokens by share that add up to ``tokens``, none beyond the ``n`` that there are."""
    order = np.argsort(n / share, kind="stable")  # those that run out come first
    before = np.cumsum(n[order]) - n[order]
    rest = np.cumsum(share[order][::-1])[::-1]
    scale = (tokens - before) / rest
    first = int(np.argmax(scale * share[order] <= n[order])) if tokens < n.sum() else len(n)
    out = n.astype(float).copy()
    out[order[first:]] = scale[first] * share[order[first:]] if first < len(n) else 0.0
    return out


def _factor(target, held, free, where=np.where, least=np.minimum, most=np.maximum):  # noqa: ANN001, ANN202
    """The step that takes the free weights of a margin value to what the held ones leave; all held ones shrink where they are too much."""
    open_step = least(STEP, most(1 / STEP, (target - held) / where(free > 0, free, 1.0)))
    full_step = where(target < held, most(1 / STEP, target / where(held > 0, held, 1.0)), 1.0)
    return where(free > 0, open_step, full_step)


def raked(n: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], budget: float) -> tuple[np.ndarray, float]:
    """(rate of each cell before the bound, what the margins miss as a share of all tokens).

    ``at``: number of each cell's value in each margin; ``targets``: tokens by value.
    """
    u = np.full(len(n), budget)
    for _ in range(ROUNDS):
        missed = 0.0
        for own, target in zip(at, targets, strict=True):
            full = u >= 1
            held = np.bincount(own, np.where(full, n, 0.0), len(target))
            free = np.bincount(own, np.where(full, 0.0, n * u), len(target))
            missed = max(missed, float(np.abs(held + free - target).max()) / n.sum())
            u = u * _factor(target, held, free)[own]
        if missed <= TOLERANCE:
            break
    return u, missed


def _rates_here(cells: DataFrame, budget: float) -> DataFrame:
    """The fit of a bounded number of cells in numpy."""
    pdf = cells.toPandas()
    n = pdf["n"].to_numpy(float)
    at, targets = [], []
    for m in MARGINS:
        values, own = np.unique(pdf[m].to_numpy(str), return_inverse=True)
        sums = np.bincount(own, n, len(values))
        at.append(own)
        targets.append(reachable(sums, shares(values.tolist(), sums, SHARES[m]), budget * n.sum()))
    u, _ = raked(n, at, targets, budget)
    out = pdf.assign(rate=np.round(np.minimum(1.0, u), DIGITS))
    return cells.sparkSession.createDataFrame(out[[*MARGINS, "n", "rate"]], "source string, lang string, topic string, n long, rate double")


def _targets(cells: DataFrame, margin: str, tokens: float) -> DataFrame:
    """(value, target) of one margin, by rounds that each hold the values that have run out."""
    given = SHARES[margin]
    sums = cells.groupBy(margin).agg(F.sum("n").cast("double").alias("n"))
    if given is None:
        sums = sums.withColumn("share", F.pow("n", F.lit(POWER)))
    else:
        named = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(margin)]
        sums = materialize(sums.withColumn("share", named), f"named-{margin}")
        others = sums.where("share is null").agg(F.sum("n")).first()[0] or 1.0
        sums = sums.withColumn("share", F.coalesce("share", F.lit(1 - sum(given.values())) * F.col("n") / F.lit(others)))
    sums = materialize(sums, f"target-{margin}")
    scale = 0.0
    while True:
        out = F.col("share") * F.lit(scale) >= F.col("n")
        r = sums.agg(F.sum(F.when(out, F.col("n"))).alias("held"), F.sum(F.when(~out, F.col("share"))).alias("open")).first()
        if not r["open"] or (found := (tokens - (r["held"] or 0)) / r["open"]) <= scale:
            return sums.select(margin, F.least("n", F.col("share") * F.lit(scale)).alias("target"))
        scale = found


def _rates_there(cells: DataFrame, budget: float) -> DataFrame:
    """The same fit with cells as a DataFrame; each step's weights are a written table."""
    total = float(cells.agg(F.sum("n")).first()[0])
    targets = {m: _targets(cells, m, budget * total) for m in MARGINS}
    fitted = cells.withColumn("u", F.lit(budget))
    choose = lambda c, a, b: F.when(c, a).otherwise(b)
    for _ in range(ROUNDS):
        missed = 0.0
        for m in MARGINS:
            full = F.col("u") >= 1
            sums = fitted.groupBy(m).agg(F.sum(choose(full, F.col("n"), 0.0)).alias("held"), F.sum(choose(full, 0.0, F.col("n") * F.col("u"))).alias("free"))
            sums = materialize(sums.join(targets[m], m), "margin")
            missed = max(missed, sums.agg(F.max(F.abs(F.col("held") + F.col("free") - F.col("target")))).first()[0] / total)
            held, free, target = F.col("held"), F.col("free"), F.col("target")
            factor = _factor(target, held, free, choose, lambda a, b: F.least(F.lit(a), b), lambda a, b: F.greatest(F.lit(a), b))
            step = sums.select(m, factor.alias("f"))
            before, fitted = fitted, materialize(fitted.join(step, m).select(*MARGINS, "n", (F.col("u") * F.col("f")).alias("u")), "raked")
            discard(before, sums)
        if missed <= TOLERANCE:
            break
    return fitted.select(*MARGINS, "n", F.round(F.least(F.lit(1.0), "u"), DIGITS).alias("rate"))


def rates(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells(source, lang, topic, n)`` with the fitted rate of each."""
    cells = materialize(cells, "cells")
    many = cells.count()
    if not many:
        return cells.withColumn("rate", F.lit(0.0))
    return _rates_here(cells, budget) if many <= MOST_CELLS else materialize(_rates_there(cells, budget), "rates")


def residual(fitted: DataFrame, budget: float = BUDGET) -> pd.DataFrame:
    """(margin, value, target, reached), both in shares of the budget, for cells that :func:`rates` fitted; a report for bounded margins."""
    pdf = fitted.toPandas()
    total, out = pdf["n"].sum(), []
    for m in MARGINS:
        g = pdf.assign(w=pdf["n"] * pdf["rate"]).groupby(m)[["n", "w"]].sum()
        target = reachable(g["n"].to_numpy(float), shares(list(g.index), g["n"].to_numpy(float), SHARES[m]), budget * total)
        out += [(m, v, t / total / budget, w / total / budget) for v, t, w in zip(g.index, target, g["w"], strict=True)]
    return pd.DataFrame(out, columns=["margin", "value", "target", "reached"])


def mix_described(own: DataFrame, names: list[str], budget: float = BUDGET) -> tuple[DataFrame, str, str]:
    """``own`` with rate and verdict, and the names of these two columns; ``names`` are those of :func:`described`."""
    keys = names[:3]
    cells = own.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, MARGINS, strict=True)]).agg(F.sum(names[3]).alias("n"))
    rate, drawn, salt = unused(own, "rate", "drawn", "salt")
    fitted = rates(cells, budget)
    fitted = fitted.select(*[F.col(m).alias(k) for k, m in zip(keys, MARGINS, strict=True)], F.col("rate").alias(rate))
    if fitted.count() <= BROADCAST_CELLS:  # a checked size; documents then stay where they are
        joined = own.join(F.broadcast(fitted), keys)
    else:  # a cell with many documents is shared out over SALTS tasks
        salted = fitted.withColumn(salt, F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        joined = own.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, [*keys, salt]).drop(salt)
    return joined.withColumn(drawn, uniform(F.col("doc_id")) < F.col(rate)), rate, drawn


def sample(docs: DataFrame, budget: float = BUDGET, topic_of: Column | None = None) -> DataFrame:
    """The documents drawn, with their own columns."""
    mixed, _, drawn = mix_described(*described(docs, topic_of), budget)
    return mixed.where(F.col(drawn)).select(docs.columns)

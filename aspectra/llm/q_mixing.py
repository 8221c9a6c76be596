"""op1: sampling rates of all documents for the target mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing as M
from .spark import materialize, table


def op1_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, names = M.described(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    seen = materialize(seen.select("doc_id", *names), "described")  # every text is read once
    mixed, rate, drawn = M.mix_described(seen, names)
    out = dict(zip([*names, rate, drawn], ["source", "lang", "topic", "n_tokens", "rate", "drawn"], strict=True))
    return mixed.select("doc_id", *[F.col(a).alias(b) for a, b in out.items()])


def mix_sql(docs: str = "documents", budget: float = M.BUDGET) -> str:
    """CTEs that end in ``mixed``: all columns of ``docs`` with source_, lang_, topic_, n_tokens, rate, drawn."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {q(p)}) THEN {q(n)}" for n, p in M.TOPICS) + " ELSE 'prose' END"
    bare = f"trim(regexp_replace(coalesce(text, ''), {q(M.GAP)}, ' ', 'g'), ' ')"
    out = [
        f"described AS (SELECT *, coalesce(source, '') AS source_, coalesce(lang, '') AS lang_, {topic} AS topic_, CAST(length({bare}) - length(replace({bare}, ' ', '')) + 1 AS BIGINT) AS n_tokens FROM {docs})",
        "cells AS (SELECT source_ AS source, lang_ AS lang, topic_ AS topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM described GROUP BY ALL)",
        f"total AS (SELECT coalesce(sum(n), 0) * {budget}::DOUBLE AS tokens FROM cells)",
    ]
    for m, given in M.SHARES.items():
        if given is None:
            share = f"pow(n, {M.POWER})"
        else:
            named = f"CASE v {' '.join(f'WHEN {q(k)} THEN {x}::DOUBLE' for k, x in given.items())} END"
            share = f"coalesce({named}, {1 - sum(given.values())!r}::DOUBLE * n / greatest(1, sum(CASE WHEN {named} IS NULL THEN n END) OVER ()))"
        out += [
            f"v_{m} AS (SELECT v, n, raw / sum(raw) OVER () AS share FROM (SELECT v, n, {share} AS raw FROM (SELECT {m} AS v, sum(n) AS n FROM cells GROUP BY {m})))",
            f"o_{m} AS (SELECT v, n, share, row_number() OVER w AS k, (tokens - (sum(n) OVER w - n)) / sum(share) OVER (ORDER BY n / share DESC, v DESC) AS scale FROM v_{m}, total WINDOW w AS (ORDER BY n / share, v))",
            f"t_{m} AS (SELECT v, CASE WHEN k < low THEN n ELSE low_scale * share END AS target FROM o_{m}, (SELECT min(k) AS low, arg_min(scale, k) AS low_scale FROM o_{m} WHERE scale * share <= n))",
        ]
    turn = lambda *of: "CASE k % 3 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(of)) + " END"
    out += [
        "start AS (SELECT c.*, t_source.target AS t0, t_lang.target AS t1, t_topic.target AS t2 FROM cells c JOIN t_source ON t_source.v = source JOIN t_lang ON t_lang.v = lang JOIN t_topic ON t_topic.v = topic)",
        f"""raked AS (SELECT 0 AS k, source, lang, topic, n, t0, t1, t2, {budget}::DOUBLE AS u FROM start
  UNION ALL SELECT k + 1, source, lang, topic, n, t0, t1, t2,
    u * CASE WHEN free > 0 THEN least({M.STEP}, greatest({1 / M.STEP}, (t - held) / free)) WHEN t < held THEN greatest({1 / M.STEP}, t / held) ELSE 1 END
  FROM (SELECT *, {turn("t0", "t1", "t2")} AS t, sum(CASE WHEN u >= 1 THEN n ELSE 0 END) OVER w AS held, sum(CASE WHEN u >= 1 THEN 0 ELSE n * u END) OVER w AS free
    FROM raked WHERE k < {3 * M.ROUNDS} WINDOW w AS (PARTITION BY {turn(*M.MARGINS)})))""",
        f"fitted AS MATERIALIZED (SELECT source, lang, topic, round(least(1.0, u), {M.DIGITS}) AS rate FROM raked WHERE k = {3 * M.ROUNDS})",
    ]
    uniform = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
    out.append(f"mixed AS (SELECT d.*, f.rate, {uniform} < f.rate AS drawn FROM described d JOIN fitted f ON f.source = d.source_ AND f.lang = d.lang_ AND f.topic = d.topic_)")
    return ",\n".join(out)


QUERIES = {"op1_raked_mix": op1_raked_mix}
ORACLE_SQL = {
    "op1_raked_mix": f"WITH RECURSIVE {mix_sql()}\nSELECT doc_id, source_ AS source, lang_ AS lang, topic_ AS topic, n_tokens, rate, drawn FROM mixed"
}

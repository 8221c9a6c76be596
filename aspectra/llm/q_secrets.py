"""op6: secrets of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets as S
from .spark import table


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = S.scan_secrets(docs).select("doc_id", "secrets")
    base, every = F.col("secrets.base"), F.array_sort(F.concat("secrets.base", "secrets.added"))
    count = lambda kind: F.size(F.filter(base, lambda s: s["rank"] == S.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(S.spans_text(base), 256).alias("base_sha256"),
        S.spans_text(every).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def placed(name: str, pattern: str) -> str:
        p = quoted(pattern)
        return f"""{name}_raw AS (
  SELECT r, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS g FROM docs),
{name} AS (
  SELECT r, m[i] AS match,
    CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_raw))"""

    table_ = "[" + ", ".join(str(S.clog(c)) for c in range(22)) + "]"
    hexes, rest = S.CLASSES["entropy_hex"], S.CLASSES["entropy_base64"]
    allowed = " OR ".join(f"regexp_matches(match, {quoted(p.replace('*+[', '*['))})" for p in S.ALLOWED)  # RE2 has no possessive repetition and needs none
    windows = f"""windows AS (
  SELECT r, s, match, k, list_filter(range(0, length(match) - 19), lambda i:
    list_sum(list_transform(list_distinct(string_split(substr(match, i + 1, 20), '')), lambda c:
      {table_}[length(substr(match, i + 1, 20)) - length(replace(substr(match, i + 1, 20), c, '')) + 1]))
    <= CASE WHEN k = 3 THEN {S.most("entropy_hex")} ELSE {S.most("entropy_base64")} END) AS hit
  FROM (SELECT r, s, match, CASE WHEN regexp_matches(match, {quoted(hexes[0])}) THEN 3 ELSE 4 END AS k
        FROM candidate WHERE NOT ({allowed}))),
added AS (
  SELECT r, s + list_min(hit) AS s, k, s + list_max(hit) + 20 AS e FROM windows WHERE len(hit) > 0)"""
    assert hexes[1] == rest[1] == 20
    names = "['" + "', '".join(S.KINDS) + "']"
    return f"""WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{placed("assign", S.ASSIGN)},
{placed("access", S.ACCESS)},
{placed("hexes", S.HEX)},
{placed("candidate", S.CANDIDATE)},
{windows},
base AS (
  SELECT r, s, 0 AS k, s + length(match) AS e FROM assign WHERE length(regexp_extract(match, {quoted(S.ASSIGN)}, 2)) >= {S.ASSIGN_LEAST}
  UNION ALL SELECT r, s, 1, s + length(match) FROM access
  UNION ALL SELECT r, s, 2, s + length(match) FROM hexes),
every AS (
  SELECT * FROM base
  UNION ALL SELECT r, s, k, e FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.s <= a.s AND a.e <= b.e)),
lines AS (
  SELECT r, CAST(count(*) FILTER (k = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (k = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (k = 2) AS BIGINT) AS n_hex,
    string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
    string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lines USING (r)"""


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE_SQL = {"op6_secret_scan": _sql()}

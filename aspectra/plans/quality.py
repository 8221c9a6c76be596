"""Queries of model quality and of features for taggers and count models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.functions import text as T
from aspectra.functions import tokens as K
from aspectra.operators import metrics as M
from aspectra.operators import ranks

from .registry import query, quoted, table, values
from .scores import W


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as truth, not toxic as prediction, with label sets for the multi-label metrics."""
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS t", "1 - toxic AS p", "CAST((doc_id * 7919 + 104729) % 1000003 % 5 AS INT) AS fold").withColumns(
        {
            "ts": F.expr("filter(array(CASE WHEN t = 1 THEN 'POS' END, CASE WHEN doc_id % 3 = 0 THEN 'NEG' END), x -> x IS NOT NULL)"),
            "ps": F.expr("filter(array(CASE WHEN p = 1 THEN 'POS' END, CASE WHEN doc_id % 4 = 0 THEN 'NEG' END), x -> x IS NOT NULL)"),
        }
    )


BASE = """b AS (SELECT doc_id, quality AS t, 1 - toxic AS p, CAST((doc_id * 7919 + 104729) % 1000003 % 5 AS INTEGER) AS fold,
  CAST(quality = 1 AS INT) AS tpos, CAST(doc_id % 3 = 0 AS INT) AS tneg, CAST(toxic = 0 AS INT) AS ppos, CAST(doc_id % 4 = 0 AS INT) AS pneg FROM labels)"""
_F1 = lambda tp, fp, fn: f"CASE WHEN 2 * ({tp}) + ({fp}) + ({fn}) > 0 THEN 2.0::DOUBLE * ({tp}) / (2 * ({tp}) + ({fp}) + ({fn})) ELSE 0 END"
_N = lambda t, p: f"count(*) FILTER (t = {t} AND p = {p})"
MACRO = f"(({_F1(_N(1, 1), _N(0, 1), _N(1, 0))}) + ({_F1(_N(0, 0), _N(1, 0), _N(0, 1))})) / 2"
SAMPLES = "CASE WHEN tpos + tneg + ppos + pneg > 0 THEN 2.0::DOUBLE * (tpos * ppos + tneg * pneg) / (tpos + tneg + ppos + pneg) ELSE 0 END"
_BOTH, _P, _T = ("CAST(sum(tpos * ppos + tneg * pneg) AS BIGINT)", "CAST(sum(ppos + pneg) AS BIGINT)", "CAST(sum(tpos + tneg) AS BIGINT)")
MICRO = _F1(_BOTH, f"{_P} - {_BOTH}", f"{_T} - {_BOTH}")


@query("f1_mention_macro", f"WITH {BASE} SELECT {MACRO} AS f1 FROM b")
def f1_mention_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).agg(M.binary_macro(F.col("t"), F.col("p")).alias("f1"))


@query("f1_samples", f"WITH {BASE} SELECT avg({SAMPLES}) AS f1 FROM b WHERE t = 1")
def f1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("t = 1").agg(M.samples_f1(F.col("ts"), F.col("ps")).alias("f1"))


@query("f1_micro", f"WITH {BASE} SELECT {MICRO} AS f1 FROM b WHERE t = 1")
def f1_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("t = 1").agg(M.micro_f1(F.col("ts"), F.col("ps")).alias("f1"))


@query("f1_combined", f"WITH {BASE} SELECT (({MACRO}) + avg({SAMPLES}) FILTER (t = 1)) / 2 AS f1 FROM b")
def f1_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("t") == 1, F.col("ts"))
    sampled = F.avg(F.when(F.col("t") == 1, F.when(F.size(said) + F.size("ps") > 0, 2.0 * F.size(F.array_intersect(said, "ps")) / (F.size(said) + F.size("ps"))).otherwise(0.0)))
    return cells(spark, sf_dir).agg(((M.binary_macro(F.col("t"), F.col("p")) + sampled) / 2).alias("f1"))


@query(
    "evaluate_model",
    f"""WITH {BASE}, s AS (SELECT * FROM b ORDER BY doc_id LIMIT 200), m AS (SELECT {MICRO} AS micro FROM s WHERE t = 1)
SELECT count(*) AS n, {MACRO} AS mention_f1, avg({SAMPLES}) FILTER (t = 1) AS sentiment_f1, any_value(micro) AS micro_f1, (({MACRO}) + avg({SAMPLES}) FILTER (t = 1)) / 2 AS combined_f1, avg(CAST(t = p AS INT)) AS accuracy FROM s, m""",
)
def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of a model on its first 200 labelled rows, the limit of an evaluation run."""
    return M.evaluate(cells(spark, sf_dir).orderBy("doc_id").limit(200), "t", "p", "ts", "ps")


@query(
    "f1_folds",
    f"WITH {BASE}, f AS (SELECT fold, {MACRO} AS f1 FROM b GROUP BY fold) SELECT avg(f1) AS mean, stddev_pop(f1) AS std, (SELECT fold FROM f ORDER BY f1 DESC, fold LIMIT 1) AS best FROM f",
)
def f1_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = cells(spark, sf_dir).groupBy("fold").agg(M.binary_macro(F.col("t"), F.col("p")).alias("f1"))
    return folds.agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), F.max_by("fold", F.struct("f1", -F.col("fold"))).alias("best"))


@query("f1_unmasked", f"WITH {BASE} SELECT {MACRO} AS f1 FROM (SELECT t, p FROM b UNION ALL SELECT 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b))")
def f1_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that nobody labelled count as class 0, as the older metric had it."""
    labels = cells(spark, sf_dir).select("doc_id", "t", "p")
    every = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").fillna(0, ["t", "p"])
    return every.agg(M.binary_macro(F.col("t"), F.col("p")).alias("f1"))


@query(
    "weighted_prf",
    f"""WITH {BASE}, c AS (SELECT x.c, count(*) FILTER (t = x.c) AS t, count(*) FILTER (p = x.c) AS p, count(*) FILTER (t = x.c AND p = x.c) AS tp FROM b, (SELECT DISTINCT t AS c FROM b) x GROUP BY x.c)
SELECT CAST(sum(tp) AS DOUBLE) / sum(t) AS accuracy, sum(t * CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END) / sum(t) AS precision, sum(t * (tp::DOUBLE / t)) / sum(t) AS recall,
  sum(t * ({_F1('tp', 'p - tp', 't - tp')})) / sum(t) AS f1 FROM c""",
)
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weighted_prf(cells(spark, sf_dir), "t", "p")


@query("confusion", f"WITH {BASE} SELECT t, p, count(*) AS n FROM b GROUP BY t, p")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(cells(spark, sf_dir), "t", "p")


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "latency_percentiles",
    "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(n) AS n, round(avg(value), 6) AS mean, "
    + ", ".join(f"max(value) FILTER (k = round_even((n - 1) * {p}::DOUBLE, 0)) AS {k}" for k, p in SHARES.items())
    + " FROM r",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_rank(table(spark, sf_dir, "events"), "value", SHARES).withColumn("mean", F.round("mean", 6))


GATES = "doc_id % 100 / 100.0 AS old, doc_id % 100 / 100.0 + (doc_id % 7 - 3) / 200.0 AS new"


@query("model_gate", f"SELECT doc_id AS n, round(new::DOUBLE - old::DOUBLE, 9) >= 0.01 AS promoted FROM (SELECT doc_id, {GATES} FROM documents)")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id AS n", *GATES.split(", "))
    return df.select("n", M.better_by(F.col("new").cast("double"), F.col("old").cast("double")).alias("promoted"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent, pos, word, tag): turns as sentences, the role as the tag of their words."""
    own = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sent"), F.col("role").alias("tag"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    return own.select("sent", "pos", "word", "tag")


WORDS = f"""w AS (SELECT conv_id || ':' || turn AS sent, role AS tag, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '{W}+'), lambda x: x <> '') AS ws FROM conversations))"""


@query(
    "token_counts",
    f"""WITH {WORDS}, c AS (SELECT lower(word) AS word, tag, count(*) AS n FROM w GROUP BY ALL)
SELECT word, CAST(sum(n) AS BIGINT) AS n, (array_agg(tag ORDER BY n DESC, tag))[1] AS top_tag FROM c GROUP BY word""",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words(spark, sf_dir).groupBy(F.lower("word").alias("word"), "tag").agg(F.count("*").alias("n"))
    return c.groupBy("word").agg(F.sum("n").alias("n"), F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("top_tag"))


@query("tag_counts", f"WITH {WORDS} SELECT tag, count(*) AS n, count(DISTINCT sent) AS sentences FROM w GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("sent").alias("sentences"))


@query("oov_stats", f"WITH {WORDS}, c AS (SELECT lower(word) AS word, count(*) AS n FROM w GROUP BY ALL) SELECT count(*) AS vocabulary, count(*) FILTER (n >= 2) AS frequent, 1 - count(*) FILTER (n >= 2)::DOUBLE / count(*) AS oov_rate FROM c")
def oov_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words(spark, sf_dir).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    s = c.agg(F.count("*").alias("vocabulary"), F.count_if(F.col("n") >= 2).alias("frequent"))
    return s.withColumn("oov_rate", 1 - F.col("frequent") / F.col("vocabulary"))


@query("vocab_ids", f"WITH {WORDS}, c AS (SELECT lower(word) AS word FROM w GROUP BY ALL HAVING count(*) >= 2) SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS id FROM c")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by byte order of the words."""
    c = words(spark, sf_dir).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).where("n >= 2")
    return ranks.running(c.select("word"), "word", "rank").select("word", (F.col("rank") - 1).cast("long").alias("id"))


@query("tag_transitions", f"""WITH {WORDS}, p AS (SELECT CASE WHEN pos % 2 = 0 THEN tag ELSE 'odd' END AS tag, lead(CASE WHEN pos % 2 = 0 THEN tag ELSE 'odd' END) OVER (PARTITION BY sent ORDER BY pos) AS nxt FROM w),
c AS (SELECT tag, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL) SELECT tag, nxt, n, n::DOUBLE / sum(n) OVER (PARTITION BY tag) AS p FROM c""")
def tag_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = words(spark, sf_dir).withColumn("tag", F.when(F.col("pos") % 2 == 0, F.col("tag")).otherwise("odd"))
    pairs = own.withColumn("nxt", F.lead("tag").over(Window.partitionBy("sent").orderBy("pos"))).where("nxt IS NOT NULL")
    c = pairs.groupBy("tag", "nxt").agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("tag")))


SPAN = 3  # words of context on either side


@query(
    "context_features",
    f"""WITH {WORDS} SELECT sent, pos, lag(word) OVER s AS prev, lead(word) OVER s AS nxt, pos = 0 AS first, pos = count(*) OVER (PARTITION BY sent) - 1 AS last,
  pos::DOUBLE / greatest(count(*) OVER (PARTITION BY sent) - 1, 1) AS place, CAST(least(count(*) OVER (PARTITION BY sent) // 5, 10) AS INTEGER) AS length_bin,
  lower(lag(word) OVER s) || '_' || lower(word) AS bigram, lower(lag(word, 2) OVER s) || '_' || lower(lag(word) OVER s) || '_' || lower(word) AS trigram,
  coalesce(regexp_matches(lag(word) OVER s, '[.,!?;:]'), false) AS after_punct, coalesce(regexp_matches(lead(word) OVER s, '[.,!?;:]'), false) AS before_punct
  FROM w WINDOW s AS (PARTITION BY sent ORDER BY pos)""",
)
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by offset in the sentence's own array: no shuffle."""
    n = F.size("ws")
    marked = lambda k: F.coalesce(_at(k).rlike("[.,!?;:]"), F.lit(False))
    return _positions(spark, sf_dir).select(
        "sent", "pos", _at(-1).alias("prev"), _at(1).alias("nxt"), (F.col("pos") == 0).alias("first"), (F.col("pos") == n - 1).alias("last"),
        (F.col("pos") / F.greatest(n - 1, F.lit(1))).alias("place"), F.least(F.floor(n / 5), F.lit(10)).cast("int").alias("length_bin"),
        _joined(2).alias("bigram"), _joined(3).alias("trigram"), marked(-1).alias("after_punct"), marked(1).alias("before_punct"),
    )


@query(
    "context_window",
    f"""WITH {WORDS} SELECT a.sent, a.pos, CAST(b.pos - a.pos AS INTEGER) AS away, lower(b.word) AS word, regexp_matches(b.word, '^\\p{{Lu}}') AS cap, CAST(length(lower(b.word)) AS INTEGER) AS size
FROM w a JOIN w b ON a.sent = b.sent AND b.pos <> a.pos AND b.pos BETWEEN a.pos - {SPAN} AND a.pos + {SPAN}""",
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word within three places of another, with its case and length."""
    near = F.filter(F.sequence(F.greatest(F.col("pos") - SPAN, F.lit(0)), F.least(F.col("pos") + SPAN, F.size("ws") - 1)), lambda k: k != F.col("pos"))
    own = _positions(spark, sf_dir).select("sent", "pos", "ws", F.explode(near).alias("k"))
    word = F.get("ws", F.col("k"))
    return own.select("sent", "pos", (F.col("k") - F.col("pos")).alias("away"), F.lower(word).alias("word"), word.rlike(r"^\p{Lu}").alias("cap"), F.length(F.lower(word)).alias("size"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent, tag, ws, pos, word): each word with its whole sentence."""
    own = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sent"), F.col("role").alias("tag"), T.tokens(F.col("text")).alias("ws"))
    return own.select("*", F.posexplode("ws").alias("pos", "word"))


def _at(k: int) -> Column:
    return F.when(F.col("pos") + k >= 0, F.get("ws", F.col("pos") + k))


def _joined(n: int) -> Column:
    """The word and those before it, n in all, lower-cased; null where there are fewer."""
    return F.when(F.col("pos") >= n - 1, F.lower(F.array_join(F.slice("ws", F.col("pos") - n + 2, F.lit(n)), "_")))


SHAPE = "left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g'), '[.,!?;:]', '.', 'g'), 15)"


RUNS = "array_to_string(list_transform(range(1, len(string_split(shape, '')) + 1), lambda i: CASE WHEN i > 1 AND string_split(shape, '')[i] = string_split(shape, '')[i - 1] THEN '' ELSE string_split(shape, '')[i] END), '')"
CASE_SQL = r"""CASE WHEN word = '' THEN 'EMPTY' WHEN regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '\p{Ll}') THEN 'ALL_UPPER'
  WHEN regexp_matches(word, '\p{Ll}') AND NOT regexp_matches(word, '\p{Lu}') THEN 'ALL_LOWER'
  WHEN regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '\p{L}\p{Lu}|(^|[^\p{L}])\p{Ll}') THEN 'TITLE_CASE'
  WHEN regexp_matches(word, '^\p{Lu}') THEN 'FIRST_UPPER' ELSE 'MIXED_CASE' END"""
CLUSTER_SQL = f"CASE {' '.join(f'WHEN regexp_matches(lower(word), {quoted(p)}) THEN {quoted(n)}' for n, p in K.CLUSTERS)} ELSE 'SHAPE_' || {RUNS} || '_CLUSTER' END"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word").distinct()


@query("word_shape", f"WITH {WORDS} SELECT DISTINCT word, {SHAPE} AS shape FROM w")
def word_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("word", K.shape(F.col("word")).alias("shape"))


@query("token_class", f"WITH {WORDS} SELECT DISTINCT word, CASE " + " ".join(f"WHEN regexp_matches(word, {quoted(p)}) THEN {quoted(n)}" for n, p in K.TOKEN_CLASSES) + " ELSE 'WORD' END AS class FROM w")
def token_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("word", K.token_class(F.col("word")).alias("class"))


@query(
    "affixes",
    f"""WITH {WORDS}, v AS (SELECT DISTINCT lower(word) AS low FROM w), k AS (SELECT low, CAST(unnest(range(1, least(6, length(low)) + 1)) AS INTEGER) AS n FROM v)
SELECT low, 'prefix' AS kind, n, left(low, n) AS value FROM k UNION ALL SELECT low, 'suffix', n, right(low, n) FROM k""",
)
def affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = words(spark, sf_dir).select(F.lower("word").alias("low")).distinct()
    return low.select("low", F.explode(K.affixes(F.col("low"))).alias("a")).select("low", "a.*")


@query(
    "char_ratios",
    f"""WITH {WORDS}, v AS (SELECT DISTINCT word, length(word)::DOUBLE AS n FROM w) SELECT word, (n - length(regexp_replace(word, '[0-9]', '', 'g'))) / n AS digits,
  (n - length(regexp_replace(lower(word), '[aeiou]', '', 'g'))) / n AS vowels,
  round(n * 0.1 + length(regexp_replace(word, '\\p{{L}}', '', 'g')) * 0.3 + len(list_distinct(string_split(lower(word), ''))) / n * 2, 9) AS complexity FROM v""",
)
def char_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return vocabulary(spark, sf_dir).select("word", K.share(w, "[0-9]").alias("digits"), K.share(F.lower(w), "[aeiou]").alias("vowels"), F.round(K.complexity(w), 9).alias("complexity"))


@query("short_shape", f"WITH {WORDS}, v AS (SELECT DISTINCT word, {SHAPE} AS shape FROM w) SELECT word, {RUNS} AS short FROM v")
def short_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("word", K.short_shape(F.col("word")).alias("short"))


@query("word_cluster", f"WITH {WORDS}, v AS (SELECT DISTINCT word, {SHAPE} AS shape FROM w) SELECT word, {CLUSTER_SQL} AS cluster FROM v")
def word_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("word", K.cluster(F.col("word")).alias("cluster"))


def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine kinds of features by tag: words are counted by tag first, so what depends on the word alone is made once a word."""
    w, low = F.col("word"), F.lower("word")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    affixes_ = F.transform(K.affixes(w), lambda a: F.struct(a["kind"].alias("type"), a["value"].alias("value")))
    known = F.array(*[F.lit(e) for own in K.ENDINGS.values() for e in own])
    endings = F.transform(F.filter(known, lambda e: low.endswith(e)), lambda e: pair("morphology", (F.length(e) / F.length(low)).cast("decimal(8,6)").cast("string")))
    plain = F.array(pair("shape", K.shape(w)), pair("case", K.case_pattern(w)), pair("length", F.least(F.length(w), F.lit(20)).cast("string")), pair("cluster", K.cluster(w)))
    counted = words(spark, sf_dir).groupBy("word", "tag").agg(F.count("*").alias("n"))
    alone = counted.select("tag", "n", F.explode(F.concat(affixes_, endings, plain)).alias("f")).select("f.type", "f.value", "tag", "n")
    before = F.array(pair("bigram", _joined(2)), pair("trigram", _joined(3)))
    near = _positions(spark, sf_dir).select("tag", F.explode(F.filter(before, lambda x: x["value"].isNotNull())).alias("f")).select("f.type", "f.value", "tag", F.lit(1).cast("long").alias("n"))
    return alone.unionByName(near).groupBy("type", "value", "tag").agg(F.sum("n").alias("n"))


FEATURES = f"""{WORDS}, c AS (SELECT word, tag, count(*) AS n, {SHAPE} AS shape FROM w GROUP BY word, tag),
k AS (SELECT *, CAST(unnest(range(1, least(6, length(word)) + 1)) AS INTEGER) AS i FROM c),
e AS (SELECT tag, 'suffix' AS type, right(lower(word), i) AS value, n FROM k UNION ALL SELECT tag, 'prefix', left(lower(word), i), n FROM k
  UNION ALL SELECT tag, 'shape', shape, n FROM c UNION ALL SELECT tag, 'length', CAST(least(length(word), 20) AS VARCHAR), n FROM c
  UNION ALL SELECT tag, 'case', {CASE_SQL}, n FROM c UNION ALL SELECT tag, 'cluster', {CLUSTER_SQL}, n FROM c
  UNION ALL SELECT tag, 'morphology', CAST(CAST(length(ending)::DOUBLE / length(word) AS DECIMAL(8,6)) AS VARCHAR), n FROM c JOIN {values([(e,) for own in K.ENDINGS.values() for e in own], "ending")} ON ends_with(lower(word), ending)
  UNION ALL SELECT tag, 'bigram', lower(lag(word) OVER s) || '_' || lower(word), 1 FROM w WINDOW s AS (PARTITION BY sent ORDER BY pos)
  UNION ALL SELECT tag, 'trigram', lower(lag(word, 2) OVER s) || '_' || lower(lag(word) OVER s) || '_' || lower(word), 1 FROM w WINDOW s AS (PARTITION BY sent ORDER BY pos)),
f AS (SELECT type, value, tag, CAST(sum(n) AS BIGINT) AS n FROM e WHERE value IS NOT NULL GROUP BY ALL)"""
PROBS = f"""{FEATURES}, g AS (SELECT type, value, sum(n)::DOUBLE AS total FROM f GROUP BY ALL HAVING sum(n) >= 2), t AS (SELECT DISTINCT tag FROM w),
p AS (SELECT g.type, g.value, t.tag, (coalesce(f.n, 0) + 0.01::DOUBLE) / (g.total + 0.01::DOUBLE * (SELECT count(*) FROM t)) AS p FROM g CROSS JOIN t LEFT JOIN f ON f.type = g.type AND f.value = g.value AND f.tag = t.tag)"""


@query("feature_tag_counts", f"WITH {FEATURES} SELECT * FROM f")
def feature_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_counts(spark, sf_dir)


@query("feature_probs", f"WITH {PROBS} SELECT type, value, tag, round(p, 9) AS p FROM p")
def feature_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed P(tag | feature); the tags are few and come along as an array, so nothing is crossed."""
    tags = words(spark, sf_dir).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    f = feature_counts(spark, sf_dir).groupBy("type", "value").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"), F.sum("n").alias("total")).where("total >= 2")
    each = f.crossJoin(F.broadcast(tags)).select("type", "value", "total", "m", F.explode("tags").alias("tag"), F.size("tags").alias("k"))
    return each.select("type", "value", "tag", F.round((F.coalesce(F.try_element_at("m", "tag"), F.lit(0)) + 0.01) / (F.col("total") + 0.01 * F.col("k")), 9).alias("p"))


BASES = f"CASE type {' '.join(f'WHEN {quoted(k)} THEN {v}::DOUBLE' for k, v in K.BASE_WEIGHTS.items())} END"


@query("feature_weights", f"""WITH {PROBS}, h AS (SELECT type, value, -sum(round(p, 9) * log2(round(p, 9))) AS h FROM p GROUP BY ALL)
SELECT type, round(avg(h), 6) AS entropy, round({BASES} * (2 - avg(h) / log2((SELECT count(*) FROM t))) * (1 + count(*)::DOUBLE / (1 + (SELECT count(DISTINCT lower(word)) FROM w))), 6) AS weight FROM h GROUP BY type""")
def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = feature_probs(spark, sf_dir).groupBy("type", "value").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("k"))
    own = h.groupBy("type").agg(F.avg("h").alias("a"), F.count("*").alias("n"), F.max("k").alias("k"))
    size = words(spark, sf_dir).agg(F.count_distinct(F.lower("word")).alias("v"))
    base = F.create_map(*[F.lit(x) for kv in K.BASE_WEIGHTS.items() for x in kv])[F.col("type")]
    weight = base * (2 - F.col("a") / F.log2("k")) * (1 + F.col("n") / (1 + F.col("v")))
    return own.crossJoin(F.broadcast(size)).select("type", F.round("a", 6).alias("entropy"), F.round(weight, 6).alias("weight"))


GRAMS = f"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{W}+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM d)"""


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, gram, n): words and pairs of ``docs(doc_id, text)``, counted within each document's own array."""
    own = docs.select("doc_id", T.tokens(F.lower("text")).alias("ws"))
    pairs = F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    own = own.select("doc_id", F.sort_array(F.concat("ws", pairs)).alias("g")).where(F.size("g") > 0)
    # equal grams are neighbours now: a run's length is the distance to the next run's start
    starts = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    own = own.select("doc_id", "g", starts.alias("at"))
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("g")))
    own = own.select("doc_id", F.explode(F.zip_with("at", ends, lambda a, b: F.struct(F.get("g", a).alias("gram"), (b - a).cast("long").alias("n")))).alias("x"))
    return own.select("doc_id", "x.gram", "x.n")


@query("ngram_df_bounds", f"WITH {GRAMS} SELECT gram, count(DISTINCT doc_id) AS df, count(*) AS n FROM g GROUP BY gram HAVING count(DISTINCT doc_id) BETWEEN 5 AND 0.8 * (SELECT count(*) FROM documents) ORDER BY n DESC, gram LIMIT 1500")
def ngram_df_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document sends each of its n-grams once, with its count; sums start before the only shuffle."""
    once = grams(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"))
    df = once.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("n")).crossJoin(F.broadcast(total))
    return df.where((F.col("df") >= 5) & (F.col("df") <= 0.8 * F.col("docs"))).select("gram", "df", "n").orderBy(F.desc("n"), "gram").limit(1500)


@query(
    "chi2_top",
    f"""WITH {GRAMS}, c AS (SELECT gram AS feature, quality AS label, count(*)::DOUBLE AS n FROM g JOIN labels USING (doc_id) GROUP BY ALL), s AS (SELECT quality AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM labels JOIN documents USING (doc_id) GROUP BY quality),
t AS (SELECT feature, sum(n) AS total FROM c GROUP BY feature),
x AS (SELECT t.feature, round(sum(pow(coalesce(c.n, 0) - total * share, 2) / (total * share)), 6) AS chi2 FROM t CROSS JOIN s LEFT JOIN c ON c.feature = t.feature AND c.label = s.label GROUP BY t.feature)
SELECT feature, chi2 FROM x ORDER BY chi2 DESC, feature LIMIT 500""",
)
def chi2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    own = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")  # texts without a label are not cut up
    cells_ = grams(own.select(F.struct("doc_id", "label").alias("doc_id"), "text")).groupBy(F.col("gram").alias("feature"), F.col("doc_id.label").alias("label")).agg(F.sum("n").alias("n"))
    counts = labels.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("label").agg(F.count("*").alias("c"))
    classes = counts.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("total")))).select("label", (F.col("c") / F.col("total")).alias("share"))
    return M.chi_square(cells_, classes).select("feature", F.round("chi2", 6).alias("chi2")).orderBy(F.desc("chi2"), "feature").limit(500)


@query("log_prob_math", f"WITH {WORDS}, c AS (SELECT lower(word) AS word, count(*) AS n FROM w GROUP BY ALL) SELECT word, round(ln(n::DOUBLE / (SELECT sum(n) FROM c)), 9) AS logp, round(1 / (1 + exp(-n::DOUBLE)), 9) AS sigmoid FROM c")
def log_prob_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words(spark, sf_dir).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("word", F.round(F.log(F.col("n") / F.col("t")), 9).alias("logp"), F.round(1 / (1 + F.exp(-F.col("n"))), 9).alias("sigmoid"))

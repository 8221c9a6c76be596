"""Queries that parse events, URLs, pages and sentiment payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import fields
from aspectra.functions import sentiment as S
from aspectra.functions import text as T
from aspectra.streaming.pipeline import EVENT, to_messages

from .registry import query, quoted, table, values
from .scores import CARD_SQL, LONG, aspect_scorecard, legacy, reviews, scored


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(
    "parse_event_json",
    """SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS k, coalesce(props->>'$.product_id', 'unknown') AS product_id FROM events""",
)
def parse_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string, product_id string").alias("d"))
    return parsed.select("event_id", F.col("d.k").alias("k"), F.coalesce("d.product_id", F.lit("unknown")).alias("product_id"))


#: Payloads of every kind by row; the same text in both engines' SQL.
MALFORMED = """CASE event_id % 8 WHEN 0 THEN concat('{"product_id":"p', event_id, '","review_content":"fine","rating":', user_id % 5, '}') WHEN 1 THEN concat('not json ', event_id) WHEN 2 THEN ''
  WHEN 3 THEN concat('[', props, ']') WHEN 4 THEN '{"product_id":"","content":"last"}' WHEN 5 THEN 'null' WHEN 6 THEN '{"Product_ID":"x","reviewContent":"c","rating":true}' ELSE props END"""
FIELDS = ("product_id", "review_content", "review_text", "reviewContent", "content", "rating", "review_id")


@query(
    "malformed_events",
    f"""WITH r AS (SELECT event_id AS n, try_cast({MALFORMED} AS JSON) AS j FROM events)
SELECT n, coalesce(j->>'$.product_id', 'unknown') AS product_id, coalesce({', '.join(f"j->>'$.{c}'" for c in FIELDS[1:5])}, '') AS text, j->>'$.rating' AS rating,
  coalesce({', '.join(f"j->>'$.{c}'" for c in FIELDS)}) IS NULL AS malformed FROM r""",
)
def malformed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("event_id AS n", f"{MALFORMED} AS raw").withColumn("d", F.from_json("raw", EVENT))
    return df.select(
        "n",
        F.coalesce("d.product_id", F.lit("unknown")).alias("product_id"),
        T.first_filled(*[F.col(f"d.{c}") for c in FIELDS[1:5]], skip_empty=False).alias("text"),
        F.col("d.rating").alias("rating"),
        F.coalesce(*[F.col(f"d.{c}") for c in FIELDS]).isNull().alias("malformed"),
    )


ALIASES = "CASE WHEN doc_id % 3 = 0 THEN text END AS a, CASE WHEN doc_id % 2 = 0 THEN '' END AS b, CASE WHEN doc_id % 5 < 3 THEN lang END AS c"


@query("text_alias_coalesce", f"SELECT doc_id, coalesce(a, b, c, '') AS text FROM (SELECT doc_id, {ALIASES} FROM documents)")
def text_alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", *ALIASES.split(", "))
    return df.select("doc_id", T.first_filled(F.col("a"), F.col("b"), F.col("c"), skip_empty=False).alias("text"))


@query("text_alias_or", f"SELECT doc_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '') AS text FROM (SELECT doc_id, {ALIASES} FROM documents)")
def text_alias_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", *ALIASES.split(", "))
    return df.select("doc_id", T.first_filled(F.col("a"), F.col("b"), F.col("c"), skip_empty=True).alias("text"))


@query(
    "surrogate_id",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) ELSE sha256(concat_ws('||', event_type, props)) END AS review_id FROM events",
)
def surrogate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", fields.surrogate_id(given, F.col("event_type"), F.col("props")).alias("review_id"))


URLS = [
    "https://www.shop.example/products/cup-i12345-s678.html", "https://shop.example/products/cup-i777.html", "https://shop.example/cup-i42",
    "https://shop.example/?itemId=99", "https://shop.example/i55?x=1", "https://shop.example/i56", "//shop.example/products/red-cup-31337.html",
    "https://shop.example/1234567-red", "https://shop.example/7654321?b", "https://shop.example/a/9999999", "https://shop.example/none", "", None,
]


URL = "url"


def _id_sql(url: str, variant: str) -> str:
    places, any_run = fields.ITEM_ID_VARIANTS[variant]
    patterns = [fields.ITEM_ID_PATTERNS[k] for k in places] or [fields.API_ID]
    tries = [f"nullif(regexp_extract({url}, {quoted(p)}, 1), '')" for p in patterns + [fields.ANY_ID] * any_run]
    return f"coalesce({', '.join(tries)}{', ' + quoted('') if any_run else ', NULL'})"


@query(
    "url_item_id",
    f"SELECT CAST(n AS BIGINT) AS n, {', '.join(f'{_id_sql(URL, v)} AS {v}_id' for v in fields.ITEM_ID_VARIANTS)} FROM "
    f"(SELECT page_id AS n, url FROM pages UNION ALL SELECT -n, url FROM {values([(k + 1, u) for k, u in enumerate(URLS)], 'n, url')})",
)
def url_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of the lookup, each with its own patterns."""
    extra = literals(spark, [(-k - 1, u) for k, u in enumerate(URLS)], "n long, url string")
    both = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url").unionByName(extra)
    return both.select("n", *[fields.item_id(F.col("url"), v).alias(f"{v}_id") for v in fields.ITEM_ID_VARIANTS])


@query(
    "html_fields",
    "SELECT page_id, " + ", ".join(f"nullif(regexp_extract(html, {quoted(p)}, 1), '') AS {n}" for n, p in fields.PAGE_FIELDS.items()) + " FROM pages",
)
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[fields.found(F.col("html"), p).alias(n) for n, p in fields.PAGE_FIELDS.items()])


#: Pages with none, one or two products between their own text.
EMBEDDED = """concat(html, CASE WHEN page_id % 3 > 0 THEN concat('"itemId":"', page_id, '","a":1,"name":"Cup ', page_id, '","priceShow":"1.00","productUrl":"//shop.example/cup"') ELSE '' END, html,
  CASE WHEN page_id % 3 > 1 THEN concat(' "itemId":"12","name":"Pot","priceShow":"', page_id, '","productUrl":"https://shop.example/pot"') ELSE '' END)"""


@query(
    "embedded_json",
    f"""WITH r AS (SELECT page_id AS n, {EMBEDDED} AS html FROM pages),
x AS (SELECT n, {', '.join(f"unnest(regexp_extract_all(html, {quoted(fields.PRODUCT_JSON)}, {k})) AS {c}" for k, c in enumerate(("item_id", "name", "price", "u"), 1))} FROM r)
SELECT n, item_id, name, price, CASE WHEN starts_with(u, '//') THEN 'https:' || u ELSE u END AS url FROM x""",
)
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").selectExpr("page_id AS n", f"{EMBEDDED} AS html")
    return df.select("n", F.explode(fields.products(F.col("html"))).alias("p")).select("n", "p.*")


@query(
    "legacy_to_multi",
    f"""WITH {LONG} SELECT doc_id AS review_id, aspect, code <> 2 AS mentioned, CASE code WHEN 1 THEN 'POS' WHEN -1 THEN 'NEG' WHEN 0 THEN 'NEU' END AS labels FROM codes""",
)
def legacy_to_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes go out as JSON and come back through the payload parser."""
    back = legacy(spark, sf_dir).select("review_id", F.explode(S.parse_payload(F.to_json("codes"))).alias("aspect", "cell"))
    return back.select("review_id", "aspect", "cell.mentioned", F.array_join("cell.sentiments", ",").alias("labels"))


@query("multi_to_legacy", f"WITH {LONG} SELECT doc_id AS review_id, aspect, code FROM codes")
def multi_to_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells go out as JSON, come back and are converted."""
    back = scored(spark, sf_dir).select("review_id", F.explode(S.parse_payload(F.to_json("cells"))).alias("aspect", "cell"))
    return back.select("review_id", "aspect", S.to_legacy(F.col("cell")).alias("code"))


A, B = S.ASPECTS[:2]
REPLIES = f"""CASE doc_id % 6 WHEN 0 THEN '{{"{A}": "POS", "{B}": null}}' WHEN 1 THEN concat('Sure! ```{{"{A}": "NEG"}}``` ok ', doc_id) WHEN 2 THEN concat('no idea ', doc_id)
  WHEN 3 THEN '{{"{A}": "GOOD", "{B}": "NEU"}}' WHEN 4 THEN concat('{{"{B}": "', CASE WHEN doc_id % 4 = 0 THEN 'POS' ELSE 'NEG' END, '"}}') END"""


@query(
    "llm_to_multi",
    f"""WITH r AS (SELECT doc_id AS n, try_cast(regexp_extract({REPLIES}, '(?s)\\{{.*\\}}') AS JSON) AS j FROM documents),
v AS (SELECT n, j->>'$."{A}"' AS a, j->>'$."{B}"' AS b FROM r)
SELECT n, CASE WHEN a IN ('NEG', 'POS', 'NEU') THEN a END AS a, CASE WHEN b IN ('NEG', 'POS', 'NEU') THEN b END AS b, CAST({len(S.ASPECTS)} AS INTEGER) AS n_aspects FROM v""",
)
def llm_to_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"{REPLIES} AS reply").withColumn("m", S.from_flat(S.parse_reply(F.col("reply"))))
    label = lambda a: F.array_join(F.try_element_at("m", F.lit(a))["sentiments"], ",")
    return df.select("n", label(A).alias("a"), label(B).alias("b"), F.size("m").alias("n_aspects"))


@query(
    "threshold_labels",
    """WITH v AS (SELECT vec_id, embedding[4]::DOUBLE > 0 AS m, embedding[1]::DOUBLE > 0 AS neg, embedding[2]::DOUBLE > 0 AS pos, embedding[3]::DOUBLE > 0 AS neu FROM embeddings)
SELECT vec_id, m AS mentioned, CASE WHEN m THEN CASE WHEN NOT (neg OR pos OR neu) THEN 'NEU' ELSE
  array_to_string(list_filter([CASE WHEN neg THEN 'NEG' END, CASE WHEN pos THEN 'POS' END, CASE WHEN neu THEN 'NEU' END], lambda x: x IS NOT NULL), ',') END END AS labels FROM v""",
)
def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    cell = S.threshold(e(3), F.array(e(0), e(1), e(2)))
    return table(spark, sf_dir, "embeddings").select("vec_id", cell.alias("c")).select("vec_id", "c.mentioned", F.array_join("c.sentiments", ",").alias("labels"))


@query(
    "argmax_label",
    "SELECT vec_id, ['NEG', 'POS', 'NEU'][list_position(embedding[1:3], list_max(embedding[1:3]))] AS label FROM embeddings",
)
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.slice("embedding", 1, 3)
    best = F.array_position(first, F.array_max(first))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(F.array(*map(F.lit, S.POLARITIES)), best.cast("int")).alias("label"))


#: Cells as sheets hold them.
CELLS = ("-1", "0", "1", "2", "", "nan", "1.0", "-1,1", "[-1,1]", " [ -1 , 1 ] ", "2,1", "7", "x", "0,1")
CELL = f"CASE doc_id % {len(CELLS) + 1} {' '.join(f'WHEN {k} THEN {quoted(c)}' for k, c in enumerate(CELLS))} END"


@query(
    "label_cells",
    f"""WITH r AS (SELECT doc_id AS n, trim(regexp_replace(trim(coalesce({CELL}, '')), '[\\[\\]]', '', 'g')) AS bare FROM documents),
c AS (SELECT n, bare, list_transform(string_split(bare, ','), lambda x: try_cast(try_cast(trim(x) AS DOUBLE) AS INTEGER)) AS codes FROM r)
SELECT n, CASE WHEN bare NOT IN ('', '2', 'nan') AND len(list_filter(codes, lambda k: k IS DISTINCT FROM 2)) > 0 THEN coalesce(nullif(array_to_string(list_filter([CASE WHEN list_contains(codes, -1) THEN 'NEG' END,
  CASE WHEN list_contains(codes, 1) THEN 'POS' END, CASE WHEN len(list_filter(codes, lambda k: k IS NULL OR k NOT IN (-1, 1, 2))) > 0 THEN 'NEU' END], lambda x: x IS NOT NULL), ','), ''), 'NEU') END AS labels FROM c""",
)
def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"{CELL} AS cell")
    return df.select("n", F.array_join(S.cell_labels(F.col("cell")), ",").alias("labels"))


@query(
    "label_cells_legacy",
    "SELECT doc_id, aspect, CASE code WHEN 0 THEN 'NEG' WHEN 1 THEN 'POS' END AS label FROM (SELECT doc_id, 'quality' AS aspect, quality AS code FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)",
)
def label_cells_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "aspect", "code")
    return long.select("doc_id", "aspect", S.legacy_cell_labels(F.col("code").cast("string")).alias("label"))


@query("labels_long_to_wide", f"WITH {LONG} SELECT doc_id AS review_id, " + ", ".join(f"max(CASE WHEN aspect = {quoted(a)} THEN code END) AS a{k}" for k, a in enumerate(S.ASPECTS)) + " FROM codes GROUP BY doc_id")
def labels_long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later entries of a list win: entries are put into a map and read by fixed aspects."""
    entries = legacy(spark, sf_dir).select("review_id", F.map_entries("codes").alias("e"))
    last = lambda a: F.element_at(F.filter("e", lambda x: x["key"] == a), -1)["value"]
    return entries.select("review_id", *[F.coalesce(last(a), F.lit(2)).alias(f"a{k}") for k, a in enumerate(S.ASPECTS)])


@query("flatten_sentiment", f"WITH {LONG} SELECT doc_id AS review_id, any_value(CAST(1 + doc_id % 5 AS INTEGER)) AS rating, " + ", ".join(f"max(CASE WHEN aspect = {quoted(a)} THEN code END) AS a{k}" for k, a in enumerate(S.ASPECTS)) + " FROM codes GROUP BY doc_id")
def flatten_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that were serialised twice are unwrapped first."""
    twice = legacy(spark, sf_dir).select("review_id", "rating", F.to_json(F.struct(F.to_json("codes").alias("s"))).alias("j"))
    codes = F.from_json(F.get_json_object("j", "$.s"), "map<string,int>")
    return twice.withColumn("m", codes).select("review_id", "rating", *[F.element_at("m", a).alias(f"a{k}") for k, a in enumerate(S.ASPECTS)])


SENTINEL = """CASE doc_id % 4 WHEN 0 THEN concat('{"a": ', doc_id % 3, '}') WHEN 1 THEN concat('{"error": "broken ', doc_id, '"}') WHEN 2 THEN concat('not json ', doc_id) ELSE '' END"""


@query(
    "error_sentinel",
    f"""WITH r AS (SELECT doc_id AS n, {SENTINEL} AS raw, try_cast({SENTINEL} AS JSON) AS j FROM documents)
SELECT n, CASE WHEN j IS NULL THEN raw ELSE j->>'$.error' END AS error, CASE WHEN j IS NOT NULL AND j->>'$.error' IS NULL THEN 1 END AS n_cells FROM r""",
)
def error_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"{SENTINEL} AS raw").withColumn("m", S.parse_payload(F.col("raw")))
    said = F.try_element_at(F.from_json("raw", "map<string,string>"), F.lit("error"))
    return df.select("n", F.when(F.col("m").isNull(), F.coalesce(said, "raw")).alias("error"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n_cells"))


@query("kafka_message", "SELECT source AS key, CAST(doc_id AS VARCHAR) AS review_id, text AS original_text, CAST(1 + doc_id % 5 AS VARCHAR) AS rating FROM documents")
def kafka_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and JSON value as a broker would get them, read back."""
    sent = to_messages(reviews(spark, sf_dir).select("product_id", F.col("review_id").cast("string").alias("review_id"), F.col("text").alias("original_text"), F.col("rating").cast("string").alias("rating")))
    got = sent.select("key", F.from_json("value", "review_id string, original_text string, rating string").alias("v"))
    return got.select("key", "v.*")


@query("display_labels_legacy", f"WITH {LONG} SELECT doc_id AS review_id, aspect, CASE code WHEN 1 THEN 'Positive' WHEN -1 THEN 'Negative' ELSE 'Neutral' END AS label FROM codes WHERE code <> 2")
def display_labels_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit(1), F.lit("Positive"), F.lit(-1), F.lit("Negative"), F.lit(0), F.lit("Neutral"))
    return legacy(spark, sf_dir).select("review_id", F.explode("codes").alias("aspect", "code")).where("code <> 2").select("review_id", "aspect", names[F.col("code")].alias("label"))


TEXTS = [
    (1, "Color: red\nSize: XL\nHelpful(0)", False), (2, "Color: red\nvery good\nHelpful (3)", True), (3, "Material: wood", False), (4, "  \n", False),
    (5, None, False), (6, "Kích  thước: 3\nNhóm màu: đỏ", False), (7, "ok", True),
]


@query("has_real_text", "SELECT CAST(n AS BIGINT) AS n, real FROM (SELECT doc_id AS n, length(trim(text)) > 0 AS real FROM documents UNION ALL SELECT -n, real FROM " + values([(n, r) for n, _, r in TEXTS], "n, real") + ")")
def has_real_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = literals(spark, [(-n, t) for n, t, _ in TEXTS], "n long, text string")
    both = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "text").unionByName(extra)
    return both.select("n", T.has_real_text(F.col("text")).alias("real"))


@query("display_text", "SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS shown FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.display(F.col("text")).alias("shown"))


COUNTS = """CASE doc_id % 5 WHEN 0 THEN concat('(', 1 + doc_id % 9, '.', 100 + doc_id % 900, ')') WHEN 1 THEN concat('', doc_id) WHEN 2 THEN concat('(', 1 + doc_id % 9, ',000)') WHEN 3 THEN 'many' END"""
LIKES = """CASE doc_id % 4 WHEN 0 THEN concat(doc_id, ' likes') WHEN 1 THEN concat('(', doc_id % 50, ')') WHEN 2 THEN 'none' END"""
PAGING = """CASE page_id % 4 WHEN 0 THEN concat('Page ', 1 + page_id % 9, ' out of ', page_id) WHEN 1 THEN concat('Page1out of', page_id) WHEN 2 THEN concat('page ', page_id) END"""
STARS = """concat(1 + doc_id % 7, CASE doc_id % 4 WHEN 0 THEN ' STAR' WHEN 1 THEN ' Sao' WHEN 2 THEN ' stars' ELSE ' all' END)"""


@query("review_count_parse", f"SELECT doc_id AS n, coalesce(try_cast(regexp_replace({COUNTS}, '[().,]', '', 'g') AS INTEGER), 0) AS count FROM documents")
def review_count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"{COUNTS} AS t").select("n", fields.review_count(F.col("t")).alias("count"))


@query("like_count_parse", f"SELECT doc_id AS n, coalesce(try_cast(nullif(regexp_extract({LIKES}, '[0-9]+'), '') AS INTEGER), 0) AS likes FROM documents")
def like_count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"{LIKES} AS t").select("n", fields.first_number(F.col("t")).alias("likes"))


@query("page_total", f"SELECT page_id AS n, try_cast(nullif(regexp_extract({PAGING}, {quoted(fields.PAGE_TOTAL)}, 2), '') AS INTEGER) AS total FROM pages")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").selectExpr("page_id AS n", f"{PAGING} AS t")
    return df.select("n", fields.found(F.col("t"), fields.PAGE_TOTAL, 2).cast("int").alias("total"))


@query("star_option", f"SELECT doc_id AS n, CASE WHEN regexp_full_match(lower({STARS}), '[1-5] (star|stars|sao)') THEN CAST(left({STARS}, 1) AS INTEGER) END AS star FROM documents")
def star_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"lower({STARS}) AS low")
    chosen = F.coalesce(*[F.when(F.col("low").isin(f"{s} star", f"{s} stars", f"{s} sao"), s) for s in range(1, 6)])
    return df.select("n", chosen.alias("star"))


@query("prompt_text", "SELECT doc_id, sha256(printf('Review: \"%s\"' || chr(10) || 'Aspects: ' || " + quoted(", ".join(f'"{a}"' for a in S.ASPECTS)) + ", text)) AS prompt_sha FROM documents")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit(", ".join(f'"{a}"' for a in S.ASPECTS))
    prompt = F.concat(F.lit('Review: "'), F.col("text"), F.lit('"\nAspects: '), names)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt, 256).alias("prompt_sha"))


@query("search_projection", "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price, 'https://shop.example/products/i' || p_partkey || '.html' AS url FROM part")
def search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("given", F.lit(None).cast("string"))
    made = F.concat(F.lit("https://shop.example/products/i"), F.col("p_partkey").cast("string"), F.lit(".html"))
    return df.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.coalesce("given", made).alias("url"))


@query("url_scheme_fix", "SELECT page_id, CASE WHEN starts_with(u, '//') THEN 'https:' || u ELSE u END AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?:', '') ELSE url END AS u FROM pages)")
def url_scheme_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?:", "")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fields.https(bare).alias("url"))


COPIES = f"""CASE doc_id % 3 WHEN 0 THEN concat('{{"{A}": ', doc_id % 3 - 1, ', "other": 5}}') WHEN 1 THEN concat('{{"{B}": ', doc_id % 2, '}}') END"""


@query("legacy_label_copy", f"""SELECT doc_id AS n, CAST({COPIES} AS JSON)->>'$."{A}"' AS a, CAST({COPIES} AS JSON)->>'$."{B}"' AS b FROM documents""")
def legacy_label_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr("doc_id AS n", f"from_json({COPIES}, 'map<string,string>') AS m")
    return df.select("n", F.try_element_at("m", F.lit(A)).alias("a"), F.try_element_at("m", F.lit(B)).alias("b"))


@query("flat_json_get", "SELECT event_id, CAST(coalesce(props->>'$.k', '0') AS INTEGER) AS k FROM events WHERE props->>'$.k' IS NOT NULL")
def flat_json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(k.isNotNull()).select("event_id", F.coalesce(k, F.lit("0")).cast("int").alias("k"))


@query("time_formats", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyyMMddHHmmss").alias("stamp"), F.unix_timestamp(ts).alias("epoch"))


@query("comparable_products", f"SELECT product_id, n_scored, n_scored >= 2 AS can_compare FROM (SELECT product_id, count(*) FILTER (review_count > 0) AS n_scored FROM ({CARD_SQL}) GROUP BY product_id) WHERE n_scored > 0")
def comparable_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = aspect_scorecard(spark, sf_dir).groupBy("product_id").agg(F.count_if(F.col("review_count") > 0).alias("n_scored"))
    return n.where("n_scored > 0").withColumn("can_compare", F.col("n_scored") >= 2)

"""Ids, numbers and fields out of URLs, pages and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where shop URLs carry the item id, in order of preference.
ITEM_ID_PATTERNS = (
    r"-i(\d+)-s",
    r"-i(\d+)\.",
    r"-i(\d+)$",
    r"itemId=(\d+)",
    r"/i(\d+)\?",
    r"/i(\d+)$",
    r"products/.*?-(\d+)\.html",
    r"/(\d{6,})[-.]",
    r"/(\d{6,})\?",
)
#: variant: (patterns by place in the list, whether any run of six digits will do at last)
ITEM_ID_VARIANTS = {"search": (range(9), True), "strict": (range(8), False), "browser": (range(3), False), "review": ((0, 1, 2, 3, 4, 5, 7), False), "api": ((), False)}
ANY_ID = r"(\d{6,})"
API_ID = r"-i(\d+)"

#: Fields of a shop page.
PAGE_FIELDS = {"title": "<title>([^|<]+)", "price": '"priceShow":"([^"]+)"', "image": '"image":"([^"]+)"', "rating": r'"ratingScore":([\d.]+)'}
PRODUCT_JSON = r'"itemId":"(\d+)".*?"name":"([^"]+)".*?"priceShow":"([^"]+)".*?"productUrl":"([^"]+)"'
PAGE_TOTAL = r"Page\s*(\d+)\s*out of\s*(\d+)"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def item_id(url: Column, variant: str = "search") -> Column:
    """The first pattern that fits gives the id; a miss gives '' in ``search`` and null elsewhere."""
    places, any_run = ITEM_ID_VARIANTS[variant]
    tries = [found(url, ITEM_ID_PATTERNS[k]) for k in places] or [found(url, API_ID)]
    if any_run:
        tries += [found(url, ANY_ID), F.lit("")]
    return F.coalesce(*tries)


def surrogate_id(given: Column, *parts: Column) -> Column:
    """``given``, or a hash of the parts, so a replay gives the same id."""
    return F.coalesce(given, F.sha2(F.concat_ws("||", *parts), 256))


def https(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def review_count(text: Column) -> Column:
    """'(1.234)' as a number; anything else 0."""
    return F.coalesce(F.regexp_replace(text, "[().,]", "").try_cast("int"), F.lit(0))


def first_number(text: Column) -> Column:
    return F.coalesce(found(text, r"\d+", 0).try_cast("int"), F.lit(0))


def products(html: Column) -> Column:
    """Array of (item_id, name, price, url) of the products embedded in a page."""
    groups = [F.regexp_extract_all(html, F.lit(PRODUCT_JSON), F.lit(k)).alias(n) for k, n in enumerate(("item_id", "name", "price", "url"), 1)]
    return F.transform(F.arrays_zip(*groups), lambda p: p.withField("url", https(p["url"])))

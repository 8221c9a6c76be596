"""Secret scans: patterns plus sliding-window entropy, all in built-in functions.

Main path: column expressions only.  Three base kinds (assign, access, hex) are
pattern matches; two added kinds come from the entropy of every window of a
candidate string.  A candidate is a run of token characters; it belongs to the
hex class or to the base64 class and each class has a window and a threshold.
The counts of all symbols and the sum of ``c * log2(c)`` are carried from one
window to the next: only the symbol that leaves and the one that enters change.
Sums are whole millionths, so every engine reaches the same verdict.

Lists are walked in chunks of about the square root of their length
(:func:`_walk`), for appending to one array would copy it at every step; patterns
never repeat a group greedily, for Java's matcher would call itself at every turn.

Null text counts as empty; an empty text has no spans; matches never overlap
within a kind; a text and a candidate may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 8
#: Runs of one class: the shortest length can stand in the pattern, for a run that is too short holds no other match.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: class: (pattern of the whole candidate, window, bits that a window must reach)
CLASSES = {"entropy_hex": ("^[0-9a-fA-F]+$", 20, 3.0), "entropy_base64": ("^[A-Za-z0-9+/_=-]+$", 20, 3.8)}
#: Candidates that are no secrets (``*+``: never given back, which changes no answer here): words and words joined by marks, plain numbers, identifiers of the 8-4-4-4-12 form, placeholders, one symbol repeated.
ALLOWED = (
    "^([A-Z]?[a-z]+|[A-Z]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*+[+/_=-]*$",
    "^[0-9+/_=-]+$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr])",
    "^[+/_=-]+$",
)
SCALE = 1_000_000


def clog(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count else 0


def most(kind: str) -> int:
    """The largest sum of c * log2(c) at which a window still reaches the class's bits."""
    _, window, bits = CLASSES[kind]
    return math.floor((math.log2(window) - bits) * window * SCALE)


def _walk(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column, Column], Column]) -> Column:
    """For each item ``out(state before, item, state after)``, an array of SQL type ``kind``; states go from ``zero`` by ``step``.

    Within a chunk of about sqrt(n) items the results are appended one by one,
    and the chunks' arrays are appended whole, so copying stays near n * sqrt(n).
    """
    chunks = lambda x, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int")), lambda k: F.slice(x, k * n + 1, n))
    none, no_chunks = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(state: Column, item: Column) -> Column:
        after = F.transform(F.array(step(state["s"], item)), lambda new: F.struct(new.alias("s"), F.concat(state["o"], F.array(out(state["s"], item, new))).alias("o")))
        return after[0]

    def chunk(state: Column, part: Column) -> Column:
        start = F.struct(state["s"].alias("s"), none.alias("o"))
        return F.aggregate(part, start, one, lambda end: F.struct(end["s"].alias("s"), F.concat(state["o"], F.array(end["o"])).alias("o")))

    def walked(x: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x))).cast("int"))
        return F.when(F.size(x) > 0, F.aggregate(chunks(x, size), F.struct(zero.alias("s"), no_chunks.alias("o")), chunk, lambda end: F.flatten(end["o"]))).otherwise(none)

    return F.transform(F.array(items), walked)[0]  # a lambda's own variable: the items are made once


PLACED = "struct<start:int,end:int,match:string>"
SPAN = "struct<start:int,rank:int,end:int>"


def _placed(text: Column, pattern: str) -> Column:
    """Matches with their places: array of (start, end, match), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["match"].alias("match")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())

    def place(at: Column, pair: Column, after: Column) -> Column:
        return F.struct((at + pair["gap"]).alias("start"), after.alias("end"), pair["match"].alias("match"))

    return F.when(text.rlike(pattern), _walk(pairs, PLACED, F.lit(0), lambda at, p: at + p["gap"] + F.length(p["match"]), place)).otherwise(F.expr(f"cast(array() as array<{PLACED}>)"))


def _spans(kind: str, placed: Column) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(placed, lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end")))


def _count(counts: Column, symbol: Column) -> Column:
    """How often ``symbol`` is in the window: a sign beyond '@' for each, at the symbol's place."""
    return F.ascii(F.substring(counts, F.ascii(symbol) + 1, F.lit(1))) - F.lit(ord("@"))


def _counted(counts: Column, symbol: Column, n: Column) -> Column:
    return F.overlay(counts, F.chr(n + ord("@")), F.ascii(symbol) + 1, F.lit(1))


def _reach(match: Column, window: int, largest: int, finish: Callable[[Column, Column], Column]) -> Column:
    """``finish(first, last)``: starts, from 0, of the first and last window that reaches the threshold; (-1, -1) if none does."""
    table = F.array(*[F.lit(clog(c)).cast("long") for c in range(window + 2)])
    signs = F.split(match, "")
    none = F.lit("@" * 128)

    def state(total: Column, counts: Column, at: Column, first: Column, last: Column) -> Column:
        hit = total <= F.lit(largest)
        return F.struct(total.alias("total"), counts.alias("counts"), at.alias("at"), F.when(hit & (first < 0), at).otherwise(first).alias("first"), F.when(hit, at).otherwise(last).alias("last"))

    def add(s: Column, c: Column) -> Column:
        n = _count(s["counts"], c)
        return F.struct((s["total"] + F.get(table, n + 1) - F.get(table, n)).alias("total"), _counted(s["counts"], c, n + 1).alias("counts"))

    def drop(s: Column, c: Column) -> Column:
        n = _count(s["counts"], c)
        return F.struct((s["total"] - F.get(table, n) + F.get(table, n - 1)).alias("total"), _counted(s["counts"], c, n - 1).alias("counts"))

    def slide(s: Column, move: Column) -> Column:
        less = F.transform(F.array(drop(s, move["old"])), lambda x: F.transform(F.array(add(x, move["new"])), lambda y: state(y["total"], y["counts"], s["at"] + 1, s["first"], s["last"]))[0])
        return less[0]

    def search(chars: Column) -> Column:
        head = F.aggregate(F.slice(chars, 1, window), F.struct(F.lit(0).cast("long").alias("total"), none.alias("counts")), add)
        start = F.transform(F.array(head), lambda h: state(h["total"], h["counts"], F.lit(0), F.lit(-1), F.lit(-1)))[0]
        # a move: the symbol that leaves and the one that enters
        moves = F.arrays_zip(F.slice(chars, 1, F.size(chars) - window).alias("old"), F.slice(chars, window + 1, F.size(chars) - window).alias("new"))
        return F.aggregate(moves, start, slide, lambda s: finish(s["first"], s["last"]))

    return F.transform(F.array(signs), search)[0]


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind: array of (start, rank, end)."""
    assign = F.filter(_placed(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.array_sort(
        F.concat(_spans("assign", assign), _spans("access", _placed(text, ACCESS)), _spans("hex", _placed(text, HEX)))
    )


def entropy_spans(text: Column) -> Column:
    """Spans that the windows add, allow-listed candidates left out: array of (start, rank, end)."""
    allowed = lambda m: F.greatest(*[m["match"].rlike(p).cast("int") for p in ALLOWED]) == 1
    candidates = F.filter(_placed(text, CANDIDATE), lambda m: ~allowed(m))
    hexes, rest = CLASSES["entropy_hex"], CLASSES["entropy_base64"]

    def judge(kind: str, m: Column) -> Column:
        def span(first: Column, last: Column) -> Column:
            end = F.when(first < 0, -1).otherwise(m["start"] + last + CLASSES[kind][1])
            return F.struct((m["start"] + first).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))

        return _reach(m["match"], CLASSES[kind][1], most(kind), span)

    judged = F.transform(
        candidates,
        lambda m: F.when(m["match"].rlike(hexes[0]), judge("entropy_hex", m)).otherwise(judge("entropy_base64", m)),
    )
    assert rest[1] <= 20 and hexes[1] <= 20, "a candidate is as long as a window at least"
    return F.filter(judged, lambda s: s["end"] >= 0)


def scan_secrets(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add ``into``: struct of ``base`` and ``added``, arrays of (start, rank, end).

    An added span that lies within one base span is left out, for that secret is
    already reported.  All other columns stay; a column named ``into`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(into, F.transform(F.array(base_spans(whole)), lambda base: F.struct(base.alias("base"), fresh(base, entropy_spans(whole)).alias("added")))[0])


def fresh(base: Column, added: Column) -> Column:
    """Those of ``added`` that lie within no span of ``base``.

    By start, base first among equals, a span lies within an earlier base span
    where that ends as late: the latest end so far is all that is carried.
    """

    def walked(every: Column) -> Column:
        own = lambda s: s["rank"] < 3
        reach = lambda end, s: F.when(own(s), F.greatest(end, s["end"])).otherwise(end)
        seen = _walk(every, f"struct<s:{SPAN},hidden:boolean>", F.lit(-1), reach, lambda end, s, _: F.struct(s.alias("s"), (own(s) | (s["end"] <= end)).alias("hidden")))
        return F.transform(F.filter(seen, lambda x: ~x["hidden"]), lambda x: x["s"])

    both = lambda a: F.when((F.size(a) > 0) & (F.size(base) > 0), F.transform(F.array(F.array_sort(F.concat(base, a))), walked)[0]).otherwise(a)
    return F.transform(F.array(added), both)[0]


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mask``; spans that overlap or touch become one. ``spans``: sorted by start.

    A chunk of about sqrt(n) spans takes its stretch of the text once, and each of
    its spans a piece of that stretch.
    """
    kind = "struct<since:int,start:int,end:int>"

    def gap(end: Column, s: Column, _: Column) -> Column:
        return F.struct(end.alias("since"), s["start"].alias("start"), s["end"].alias("end"))

    def replaced(seen: Column) -> Column:
        # what lies between two spans that do not touch stays; a text's first span may start at 0
        first = lambda s: (s["start"] > s["since"]) | (s["since"] == 0)
        return F.transform(F.array(F.filter(seen, first)), lambda parts: pieced(parts, F.get(seen, F.size(seen) - 1)))[0]

    def pieced(parts: Column, last: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(parts))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / n).cast("int")), lambda k: F.slice(parts, k * n + 1, n))

        def chunk(own: Column) -> Column:
            low, high = F.get(own, F.lit(0))["since"], F.get(own, F.size(own) - 1)["start"]
            stretch = F.struct(low.alias("low"), F.substring(text, low + 1, high - low).alias("text"))
            cut = lambda w: F.concat_ws("", F.transform(own, lambda s: F.concat(F.substring(w["text"], s["since"] - w["low"] + 1, s["start"] - s["since"]), F.lit(mask))))
            return F.transform(F.array(stretch), cut)[0]

        end = F.greatest(last["since"], last["end"])
        return F.concat(F.concat_ws("", F.transform(chunks, chunk)), F.substring(text, end + 1, F.length(text)))

    seen = _walk(spans, kind, F.lit(0), lambda end, s: F.greatest(end, s["end"]), gap)
    return F.when(F.size(spans) > 0, F.transform(F.array(seen), replaced)[0]).otherwise(text)

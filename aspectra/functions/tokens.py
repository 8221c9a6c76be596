"""Word features for taggers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
#: Class of a word by the first pattern that fits; the last name is for none.
TOKEN_CLASSES = (
    ("NUM", "^[0-9]+$"),
    ("EMAIL", EMAIL),
    ("URL", r"^(https?://|www\.)"),
    ("CURRENCY", "[$€£¥¢₹₽]"),
    ("DATE", r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"),
    ("TIME", "^[0-9]{1,2}:[0-9]{2}"),
    ("PERCENT", "%$"),
    ("ORDINAL", "^[0-9]+(st|nd|rd|th|ST|ND|RD|TH)$"),
    ("CARDINAL", "^[.,]*[0-9][0-9.,]*$"),
    ("PROPER", r"^\p{Lu}\p{L}*$"),
    ("PUNCT", r"[.,!?;:()\[\]{}]"),
    ("HYPHEN", "-"),
    ("APOSTROPHE", "'"),
)
#: Endings by part of speech.
ENDINGS = {
    "verb": ("ing", "ed", "er", "est", "s", "es", "en"),
    "noun": ("tion", "sion", "ness", "ment", "ity", "ty", "ism", "ist", "ance", "ence"),
    "adjective": ("able", "ible", "ful", "less", "ous", "ive", "al", "ic", "ical", "ary", "ish"),
    "adverb": ("ly", "ward", "wise", "ways"),
}

#: Clusters of a word by the first pattern that fits its lower-cased form; a word without any goes by its short shape.
CLUSTERS = (
    ("EMAIL_CLUSTER", EMAIL),
    ("URL_CLUSTER", r"^https?://|^www\."),
    ("CURRENCY_CLUSTER", "[$€£¥¢₹₽]"),
    ("DATE_CLUSTER", r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"),
    ("TIME_CLUSTER", "^[0-9]{1,2}:[0-9]{2}"),
    ("NUMBER_CLUSTER", "^[.,]*[0-9][0-9.,]*$"),
    ("ALPHANUMERIC_CLUSTER", "[0-9]"),
    ("HYPHENATED_CLUSTER", "-"),
    ("VERB_MORPH_CLUSTER", f"({'|'.join(ENDINGS['verb'])})$"),
    ("NOUN_MORPH_CLUSTER", f"({'|'.join(ENDINGS['noun'])})$"),
    ("ADJ_MORPH_CLUSTER", f"({'|'.join(ENDINGS['adjective'])})$"),
    ("ADV_MORPH_CLUSTER", f"({'|'.join(ENDINGS['adverb'])})$"),
)
#: Base weight of each kind of feature.
BASE_WEIGHTS = {
    "suffix": 4.0, "prefix": 2.0, "shape": 3.0, "case": 2.5, "length": 1.0,
    "bigram": 3.5, "trigram": 5.0, "cluster": 3.0, "morphology": 4.5,
}


def shape(word: Column) -> Column:
    """X for A-Z, x for a-z, d for digits, . for stops; 15 characters at most."""
    for pattern, sign in (("[A-Z]", "X"), ("[a-z]", "x"), ("[0-9]", "d"), ("[.,!?;:]", ".")):
        word = F.regexp_replace(word, pattern, sign)
    return F.substring(word, 1, 15)


def short_shape(word: Column) -> Column:
    """The shape with every run of one sign as one."""
    return F.regexp_replace(shape(word), r"(.)\1+", "$1")


def case_pattern(word: Column) -> Column:
    upper, lower = word.rlike(r"\p{Lu}"), word.rlike(r"\p{Ll}")
    title = upper & ~word.rlike(r"\p{L}\p{Lu}|(^|[^\p{L}])\p{Ll}")
    return (
        F.when(word == "", "EMPTY").when(upper & ~lower, "ALL_UPPER").when(lower & ~upper, "ALL_LOWER")
        .when(title, "TITLE_CASE").when(word.rlike(r"^\p{Lu}"), "FIRST_UPPER").otherwise("MIXED_CASE")
    )


def token_class(word: Column) -> Column:
    chosen = F.lit("WORD")
    for name, pattern in reversed(TOKEN_CLASSES):
        chosen = F.when(word.rlike(pattern), name).otherwise(chosen)
    return chosen


def pseudo_class(word: Column) -> Column:
    """The class of a word that a vocabulary does not know: figures, all capitals, a capital first, -ing, then :func:`token_class`."""
    case = case_pattern(word)
    named = F.when(word.rlike("^[0-9]+$"), "NUM").when(case == "ALL_UPPER", "ALLCAPS").when(case == "TITLE_CASE", "CAP")
    return named.when(F.lower(word).endswith("ing"), "SUFFIX_ING").otherwise(token_class(word))


def cluster(word: Column) -> Column:
    low, chosen = F.lower(word), F.concat(F.lit("SHAPE_"), short_shape(word), F.lit("_CLUSTER"))
    for name, pattern in reversed(CLUSTERS):
        chosen = F.when(low.rlike(pattern), name).otherwise(chosen)
    return chosen


def affixes(word: Column, most: int = 6) -> Column:
    """Array of (kind, n, value): the first and the last n characters."""
    low = F.lower(word)
    upto = F.sequence(F.lit(1), F.least(F.lit(most), F.length(low)))
    pair = lambda kind, cut: F.transform(upto, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), cut(n).alias("value")))
    both = F.concat(pair("prefix", lambda n: F.substring(low, F.lit(1), n)), pair("suffix", lambda n: F.right(low, n)))
    return F.when(F.length(low) > 0, both).otherwise(F.expr("cast(array() AS array<struct<kind:string,n:int,value:string>>)"))


def share(word: Column, pattern: str) -> Column:
    """Share of the characters that the class holds; 0 for an empty word."""
    n = F.length(word)
    return F.when(n > 0, (n - F.length(F.regexp_replace(word, pattern, ""))) / n).otherwise(0.0)


def complexity(word: Column) -> Column:
    n = F.length(word)
    kinds = F.size(F.array_distinct(F.split(F.lower(word), "")))
    return F.when(n > 0, n * 0.1 + F.length(F.regexp_replace(word, r"\p{L}", "")) * 0.3 + kinds / n * 2).otherwise(0.0)

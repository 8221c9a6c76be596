"""Text cleaning as column expressions; classes are spelled out so that Java and RE2 agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing sees it: separators, the C0 information separators and NEL included.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: Neither letter, digit, underscore nor white space.
SIGN = r"[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
TAG = "<[^>]+>"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]+"

#: Lines of a review that only name the variant.
VARIANT_LINE = r"(Nhóm\s*[Mm]àu|Size|Kích\s*thước|Color|Màu\s*sắc)\s*:\s*[^\n]+"
HELPFUL_MARK = r"Helpful\s*\(\d+\)"
MATERIAL_LINE = r"Material\s*:\s*[^\n]+"

#: Chat abbreviations and what they stand for.
ABBREVIATIONS = {
    "ko": "không", "k": "không", "khong": "không", "kg": "không", "hok": "không",
    "dc": "được", "đc": "được", "đk": "được", "r": "rồi", "vs": "với",
    "j": "gì", "bt": "bình thường", "mk": "mình", "mik": "mình",
    "cx": "cũng", "bn": "bạn", "b": "bạn", "tks": "cảm ơn", "thanks": "cảm ơn",
    "nchung": "nói chung", "nhìu": "nhiều", "nhieu": "nhiều",
    "cty": "công ty", "nt": "nhắn tin", "sp": "sản phẩm",
    "i": "giống", "sdt": "số điện thoại",
    "ok": "tốt", "oke": "tốt", "okey": "tốt", "okie": "tốt",
    "okeyy": "tốt", "okiee": "tốt", "thik": "thích",
    "thix": "thích", "ib": "nhắn tin", "ibx": "nhắn tin",
    "inbox": "nhắn tin", "inb": "nhắn tin", "inbx": "nhắn tin",
    "sz": "cỡ", "mn": "mọi người", "mng": "mọi người",
    "sr": "xin lỗi", "sorry": "xin lỗi", "éo": "không", "kh": "không",
    "rep": "trả lời", "ship": "giao hàng", "h": "giờ",
    "lm": "làm", "rùi": "rồi", "tl": "trả lời",
}


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_stream(text: Column) -> Column:
    """Lower case, tags out, runs of white space as one space, ends trimmed; null gives ''."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TAG, "")
    return strip(F.regexp_replace(bare, f"{SPACE}+", " "))


def clean_punctuation(text: Column) -> Column:
    """Tags out, every sign to a space, lower case, ends trimmed; inner white space stays."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "")
    return strip(F.lower(F.regexp_replace(bare, SIGN, " ")))


def dedup_key(text: Column) -> Column:
    """What is equal in texts that differ in case, signs and spacing only."""
    bare = F.regexp_replace(F.lower(strip(text)), SIGN, "")
    return F.regexp_replace(bare, f"{SPACE}+", "")


def normalize(text: Column) -> Column:
    """For count models: emoji to spaces, repeated Latin runs once, signs set apart and once, ends bare of them."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), EMOJI, " ")
    x = F.regexp_replace(x, r"([a-z]+?)\1+", "$1")
    x = F.regexp_replace(x, rf"{PUNCTUATION}*({PUNCTUATION})", " $1 ")
    edge = rf"(?:{PUNCTUATION}|{SPACE})+"
    return F.regexp_replace(F.regexp_replace(x, f"^{edge}|{edge}$", ""), f"{SPACE}+", " ")


def expand_abbreviations(text: Column, table: dict[str, str] | None = None) -> Column:
    """Each word between white space that the table has, in whatever case, is written out."""
    known = F.create_map(*[F.lit(x) for kv in (table or ABBREVIATIONS).items() for x in kv])
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), " ")


def has_real_text(text: Column) -> Column:
    """Something is left besides variant, material and helpfulness lines."""
    x = F.coalesce(text, F.lit(""))
    for pattern in (VARIANT_LINE, HELPFUL_MARK, MATERIAL_LINE):
        x = F.regexp_replace(x, pattern, "")
    return F.length(strip(x)) > 0


def display(text: Column, most: int = 100) -> Column:
    """One line of at most ``most`` characters."""
    line = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def first_filled(*columns: Column, skip_empty: bool) -> Column:
    """The first that is not null (nor empty, if those are skipped), else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) if skip_empty else c for c in columns], F.lit(""))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def percent(value: Column, mark: str = "%") -> Column:
    """A number with one decimal and a mark."""
    return F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(mark))


def segment(text: Column, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """The text as a segmenter joins its words; without one, or where it gives nothing, as it is."""
    return text if segmenter is None else F.coalesce(segmenter(text), text)

"""Text and time functions with Python's notion of white space and word characters, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that str.isspace() accepts, for Java's and RE2's character classes.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Word characters, as \w means them for str patterns.
W = r"\p{L}\p{N}_"
#: Characters of a punctuated French word.
LATIN = r"0-9A-Za-zÀ-ÖØ-öø-ÿŒœÆæ"
#: A word with inner apostrophes and hyphens.
WORD = rf"[{LATIN}]+(?:['’\-][{LATIN}]+)*"
#: Word, white space, or a single other sign.
TOKEN = rf"{WORD}|[{WS}]+|[^{W}{WS}]"
#: Sentence ends of the merge rule.
SENTENCE_END = ".!?。！？…"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+", "")


def words(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, rf"[{WS}]+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_chinese(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def numbers_only(c: Column) -> Column:
    return c.rlike(rf"^[\p{{Nd}}{WS},.\-:;]+$")


def collapse_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{3}", "…")


def punctuation_ratio(c: Column) -> Column:
    """Sentence-end marks per non-blank character; 0.0 for none. Three dots are one mark."""
    bare = F.regexp_replace(c, rf"[{WS}]+", "")
    n = F.length(bare)
    marks = F.regexp_count(collapse_dots(bare), F.lit(r"[.!?…]"))
    return F.when(n == 0, F.lit(0.0)).otherwise(marks / n)


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds are rounded half to even and may read 1000."""
    whole = F.floor(seconds).cast("bigint")
    ms = F.bround((seconds % F.lit(1.0)) * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600).cast("bigint"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("bigint"), F.pmod(whole, F.lit(60)), ms)


def sanitize_word(c: Column) -> Column:
    """Without trailing punctuation, unless nothing else is left."""
    bare = F.regexp_replace(c, r"[,.?:;\-…!]+$", "")
    return F.when(bare == "", c).otherwise(bare)


def normalize_word(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "’", "'"), "[^0-9a-zà-öø-ÿœæ']", "")


def normalize_label(c: Column) -> Column:
    """Mark of a model label: LABEL_x is x; labels without a mark give the empty text."""
    x = F.regexp_replace(c, "^LABEL_", "")
    return F.when(x.isin(".", ",", "?", "-", ":"), x).otherwise("")


def strip_space_before_marks(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+([!?])", "$1")


def normalize_punctuation(c: Column) -> Column:
    """Collapse repeated marks and white space, in this order: spaced dots, dots, spaced runs, runs, spaces."""
    c = F.regexp_replace(c, rf"\.\.\.(?:[{WS}]+\.\.\.)+", "...")
    c = F.regexp_replace(c, r"\.{4,}", "...")
    c = F.regexp_replace(c, rf"([^{W}{WS}]+)(?:[{WS}]+\1){{2,}}", "$1")
    c = F.regexp_replace(c, rf"([^{W}{WS}.])\1{{2,}}", "$1")
    return strip(F.regexp_replace(c, rf"[{WS}]{{2,}}", " "))


def remove_char_patterns(c: Column) -> Column:
    """Without a pattern of 2 to 15 characters that repeats five times or more; spaces collapsed."""
    c = F.regexp_replace(c, r"([^\n]{2,15}?)(?:\1){4,}", "")
    return strip(F.regexp_replace(c, rf"[{WS}]+", " "))


def has_char_pattern(c: Column) -> Column:
    return c.rlike(r"([^\n]{2,15}?)(?:\1){4,}")


def word_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^[.,!?;:]+|[.,!?;:]+$", ""))


def file_title(c: Column) -> Column:
    """Letters, digits, spaces, hyphens and underscores of a title, as a file name of 50 characters at most."""
    bare = F.regexp_replace(F.regexp_replace(c, rf"[^{W} \-]", ""), rf"[{WS}]+$", "")
    return F.substring(F.replace(bare, F.lit(" "), F.lit("_")), 1, 50)

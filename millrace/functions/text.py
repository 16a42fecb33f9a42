"""String columns with the whitespace and null rules of the scripts this library replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as str.split() and str.strip() see it: the Unicode class plus the
# four ASCII separators that Java leaves out of it.
SPACE = r"[\s\x{1c}-\x{1f}]"
WORD = r"[^\s\x{1c}-\x{1f}]++"
UNICODE_FLAG = "(?U)"

TOKENS_PER_WORD = 1.5
PAIR_TAG_WORDS = 5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_empty(c: Column | str) -> Column:
    """Null for null or empty text, so that ``coalesce`` treats both alike."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def has_text(c: Column | str) -> Column:
    return col(c).isNotNull() & (col(c) != "")


def first_present(df: DataFrame, keys: Sequence[str], default: str | None = "") -> Column:
    """First of ``keys`` that exists in ``df`` and is neither null nor empty."""
    found = [non_empty(F.col(f"`{k}`")) for k in keys if k in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default).cast("string")


def first_map_value(m: Column | str, keys: Sequence[str], default: str | None = "") -> Column:
    """As :func:`first_present`, over the keys of a string map."""
    return F.coalesce(*[non_empty(col(m)[k]) for k in keys], F.lit(default))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"{UNICODE_FLAG}^{SPACE}++|{SPACE}++$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"{UNICODE_FLAG}{SPACE}++$", "")


def lstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"{UNICODE_FLAG}^{SPACE}++", "")


def words(c: Column | str) -> Column:
    """Whitespace-separated words, no empty entries."""
    return F.filter(F.split(col(c), f"{UNICODE_FLAG}{SPACE}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of words, in one pass over the text."""
    return F.regexp_count(col(c), F.lit(f"{UNICODE_FLAG}{WORD}"))


def estimate_tokens(c: Column | str) -> Column:
    """Words times 1.5, cut to an integer."""
    return (word_count(c) * F.lit(TOKENS_PER_WORD)).cast("bigint")


def estimate_pair_tokens(a: Column | str, b: Column | str) -> Column:
    """Estimate for a tagged pair; missing sides count no words."""
    n = word_count(F.coalesce(col(a), F.lit(""))) + word_count(F.coalesce(col(b), F.lit("")))
    return ((n + PAIR_TAG_WORDS) * F.lit(TOKENS_PER_WORD)).cast("bigint")


def before_first(c: Column | str, marker: str) -> Column:
    """Text before the first ``marker``; the whole text if it is absent."""
    return F.substring_index(col(c), marker, 1)


def drop_chars(c: Column | str, n: Column | int) -> Column:
    """Text without its first ``n`` characters."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(col(c), n + 1, F.length(col(c)))


def take_chars(c: Column | str, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(col(c), F.lit(1), n)


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def literal_pattern(text: str) -> str:
    """A regular expression matching ``text`` itself, in Java syntax."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

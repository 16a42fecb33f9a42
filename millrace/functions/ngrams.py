"""Word n-grams and their hashes for near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col

NON_WORD = "[^A-Za-z_0-9]"


def dedup_tokens(text: Column | str) -> Column:
    """Split at every character outside ``[A-Za-z_0-9]``; empty tokens stay."""
    return F.split(col(text), NON_WORD, -1)


def word_ngrams(tokens: Column | str, n: int, min_tokens: int | None = None) -> Column:
    """All ``n``-grams in order, joined by blanks; none for fewer than ``min_tokens`` tokens."""
    tokens = col(tokens)
    need = max(n, n if min_tokens is None else min_tokens)
    starts = F.sequence(F.lit(0), F.size(tokens) - F.lit(n))

    def gram(i: Column) -> Column:
        # Element access, not slice(): a slice copies the whole array each time.
        return F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])

    grams = F.transform(starts, gram)
    return F.when(F.size(tokens) >= need, grams).otherwise(F.array().cast("array<string>"))


def ngram_set(tokens: Column | str, n: int, min_tokens: int | None = None) -> Column:
    return F.array_distinct(word_ngrams(tokens, n, min_tokens))


def _head_value(digest: Column) -> Column:
    swapped = F.concat(*[F.substring(digest, p, 2) for p in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def sha1_head(text: Column | str) -> Column:
    """First four SHA-1 bytes read as a little-endian unsigned integer."""
    return _head_value(F.sha1(col(text).cast("binary")))


def sha1_heads(texts: Column) -> Column:
    """:func:`sha1_head` over an array; in two steps, so that each digest is taken once."""
    return F.transform(F.transform(texts, lambda g: F.sha1(g.cast("binary"))), _head_value)


def ngram_hashes(tokens: Column | str, n: int, min_tokens: int | None = None) -> Column:
    """SHA-1 heads of the n-grams, repeats included (a minimum ignores them)."""
    return sha1_heads(word_ngrams(tokens, n, min_tokens))

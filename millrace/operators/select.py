"""Row filters and row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import order_hash, unit_hash
from millrace.functions.text import col, has_text
from millrace.operators.prefix import ROWS_PER_BUCKET, range_bounds, range_bucket

MIN_TOKENS = 32
MAX_TOKENS = 8192
# The code filter never lets bare IR in, whatever list it is given.
NEVER_CODE = "llvm"


def within_length(tokens: Column | str = "est_tokens", low: int = MIN_TOKENS, high: int | None = MAX_TOKENS) -> Column:
    """Predicate on the token estimate; ``high=None`` sets a minimum only."""
    tokens = col(tokens)
    return tokens >= low if high is None else tokens.between(low, high)


def non_empty_rows(df: DataFrame, *columns: str) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & has_text(c)
    return df.filter(keep)


def parse_language_list(text: str) -> list[str]:
    """Comma-separated languages, lower-cased, without blanks and without bare IR."""
    names = [part.strip().lower() for part in text.split(",")]
    return [n for n in names if n and n != NEVER_CODE]


def language_allowed(lang: Column | str, allowed: Sequence[str], code: bool = True) -> Column:
    names = {a.lower() for a in allowed}
    if code:
        names.discard(NEVER_CODE)
    return F.lower(F.coalesce(col(lang), F.lit(""))).isin(sorted(names))


def keep_probability(group: Column | str, probs: Mapping[str, float], default: float = 1.0) -> Column:
    """Per-source keep probability as a literal map lookup."""
    if not probs:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in probs.items() for x in kv])
    return F.coalesce(table[col(group)], F.lit(default))


def sampled(key: Column | str, seed: int, prob: Column | float) -> Column:
    """Seeded Bernoulli predicate; at probability 1 everything stays."""
    prob = F.lit(float(prob)) if isinstance(prob, (int, float)) else prob
    return unit_hash(key, seed) <= prob


def first_seeds(df: DataFrame, n: int, seed_col: str = "seed") -> DataFrame:
    return df.filter(F.col(seed_col) < n)


def _above_or_null(name: str, value: object) -> tuple[Column, Column]:
    """Whether a column is before the value (null first), and whether it equals it."""
    column = F.col(f"`{name}`")
    before = F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
    return before, column.eqNullSafe(F.lit(value))


def _cut(df: DataFrame, order: Sequence[str], rank: int, rows_per_bucket: int) -> tuple[Column, Column, int] | None:
    """Predicates of the rows before the ``rank``-th one and of those that tie with it, and how many ties are within the rank.

    Key by key: counts per range find the range, counts per value inside that
    range find the value.  None if there are fewer rows.
    """
    rows, before, equal = df.select(*order), F.lit(False), F.lit(True)
    for name in order:
        bucket = range_bucket(F.col(f"`{name}`"), range_bounds(rows, name, rows_per_bucket))
        # at most one row per range
        counts = sorted(tuple(r) for r in rows.groupBy(bucket.alias("b")).agg(F.count("*")).collect())
        found = None
        for b, n in counts:
            if rank <= n:
                found = b
                break
            rank -= n
        if found is None:
            return None
        inside = rows.filter(bucket == found)
        values = inside.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n"))
        # the values of one range, whose rows are bounded
        upto = Window.partitionBy(F.lit(0)).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        value, n, upper = values.withColumn("upper", F.sum("n").over(upto)).filter(F.col("upper") >= rank).orderBy("upper").first()
        rank -= upper - n
        less, same = _above_or_null(name, value)
        before, equal = before | (equal & less), equal & same
        if n == 1:
            break
        rows = rows.filter(same)
    return before, equal, rank


def ordered_slice(df: DataFrame, order: Sequence[str], start: int, n: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows ``[start, start + n)`` in ``order`` (null first), as a set; both ends are clamped to the data.

    The keys of both ends are found first, from counts per range and per value,
    so the result is a filter: no row moves, whatever ``start`` and ``n`` are.
    Only rows whose whole order key is that of an end, if repeated, are counted out.
    """
    if n is not None and n <= 0:
        return df.limit(0)
    low = _cut(df, order, start, rows_per_bucket) if start > 0 else (F.lit(False), F.lit(False), 0)
    if low is None:
        return df.limit(0)
    high = None if n is None else _cut(df, order, max(0, start) + n, rows_per_bucket)
    beyond_low, at_low, skipped = ~low[0] & ~low[1], low[1], low[2]
    if high is None:
        inner, at_high, taken = df.filter(beyond_low), F.lit(False), 0
    else:
        inner, at_high, taken = df.filter(beyond_low & high[0]), high[1] & beyond_low, high[2]
    # ties of the ends: usually one row, that of a unique key
    first = df.filter(at_low)
    if start > 0:
        ties = first.count()
        if high is not None and not df.filter(at_low & high[1]).isEmpty():
            return first.limit(taken - skipped)  # both ends lie in one group of ties
        inner = inner.unionByName(first.limit(ties - skipped)) if ties > skipped else inner
    if high is None:
        return inner
    ties = df.filter(at_high)
    return inner.unionByName(ties if ties.count() == taken else ties.limit(taken))


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in ``order``, as a top-k rather than a full sort."""
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, key: str, n: int | None, seed: int) -> DataFrame:
    """``n`` rows by seeded hash order, as a set; everything when ``n`` is unset."""
    if n is None:
        return df
    hashed = df.withColumn("_order", order_hash(key, seed))
    return ordered_slice(hashed, ["_order", key], 0, n).drop("_order")


def first_candidates(df: DataFrame, n: int, candidate: str = "completion_id") -> DataFrame:
    return df.filter(F.col(candidate) < n)


def skip_reason(
    key: Column | str,
    text: Column | str,
    tokens: Column | str,
    prob: Column | float,
    seed: int,
    low: int = MIN_TOKENS,
    high: int | None = MAX_TOKENS,
) -> Column:
    """First reason to skip a row, null when it is written.

    Order of the tests: subsample, empty text, length.
    """
    return (
        F.when(~sampled(key, seed, prob), F.lit("subsample"))
        .when(~has_text(text), F.lit("empty"))
        .when(~within_length(tokens, low, high), F.lit("filter"))
    )


def skip_report(df: DataFrame, group: str, reason: Column, tokens: Column | str) -> DataFrame:
    """Per group: rows seen, skipped by reason, written, and tokens written; one pass."""
    marked = df.select(col(group).alias(group), reason.alias("reason"), col(tokens).alias("tokens"))
    written = F.col("reason").isNull()
    return marked.groupBy(group).agg(
        F.count("*").alias("rows_seen"),
        F.count_if(F.col("reason") == "subsample").alias("skipped_subsample"),
        F.count_if(F.col("reason") == "empty").alias("skipped_empty"),
        F.count_if(F.col("reason") == "filter").alias("skipped_filter"),
        F.count_if(written).alias("records_written"),
        F.coalesce(F.sum(F.when(written, F.col("tokens"))), F.lit(0)).alias("tokens_written"),
    )


def funded(targets: Mapping[str, int]) -> dict[str, int]:
    """Budgets above zero; the other sources are left out of the plan."""
    return {name: target for name, target in targets.items() if target > 0}

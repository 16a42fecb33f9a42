"""Reports over the document table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import col
from millrace.session import broadcast_if_small, materialize

SHARES = (0.25, 0.5, 0.75, 0.99)
NAMES = ("p25", "p50", "p75", "p99")


def percentiles(tokens: Column | str, approximate: bool = False) -> Column:
    """Quartiles and p99 with linear interpolation.

    The exact form keeps one counter per distinct token count, merged from
    map-side partials; ``approximate`` trades that for a fixed-size sketch.
    """
    shares = F.array(*[F.lit(s) for s in SHARES])
    return F.percentile_approx(tokens, shares, 10_000) if approximate else F.percentile(tokens, shares)


def _spread(found: str) -> list[Column]:
    return [F.col(found)[i].cast("double").alias(n) for i, n in enumerate(NAMES)]


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def source_profile(df: DataFrame, group: str = "source", tokens: str = "est_tokens", approximate: bool = False) -> DataFrame:
    """Records, tokens, share of all tokens and percentiles per source."""
    per_group = df.groupBy(group).agg(
        F.count("*").alias("records"),
        F.sum(tokens).alias("tokens"),
        percentiles(tokens, approximate).alias("_p"),
    )
    share = percent_of(F.col("tokens"), F.sum("tokens").over(Window.partitionBy()))
    return per_group.select(group, "records", "tokens", share.alias("share_pct"), *_spread("_p"))


def language_profile(
    df: DataFrame,
    group: str = "source",
    lang: str = "lang",
    tokens: str = "est_tokens",
    approximate: bool = False,
) -> DataFrame:
    """Per source and language tag: records, tokens, share within the source, percentiles.

    ``rank`` orders the languages of a source by tokens.  Rows without a tag
    are left out but count in the source's total.
    """
    per_pair = df.groupBy(group, lang).agg(
        F.count("*").alias("records"),
        F.sum(tokens).alias("tokens"),
        percentiles(tokens, approximate).alias("_p"),
    )
    in_source = F.sum("tokens").over(Window.partitionBy(group))
    shared = per_pair.withColumn("share_pct", percent_of(F.col("tokens"), in_source))
    by_tokens = Window.partitionBy(group).orderBy(F.desc("tokens"), lang)
    return shared.filter(F.col(lang) != "").select(
        group,
        lang,
        "records",
        "tokens",
        "share_pct",
        F.row_number().over(by_tokens).cast("bigint").alias("rank"),
        *_spread("_p"),
    )


def language_subtotals(df: DataFrame, group: str = "source", lang: str = "lang", tokens: str = "est_tokens") -> DataFrame:
    """Labelled rows with a subtotal per source and a grand total; ``level`` 0, 1, 3."""
    rolled = (
        df.filter(F.col(lang) != "")
        .rollup(group, lang)
        .agg(
            F.count("*").alias("records"),
            F.sum(tokens).alias("tokens"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )
    return rolled.select(
        F.when(F.col("level") == 3, F.lit("TOTAL")).otherwise(F.col(group)).alias(group),
        F.when(F.col("level") > 0, F.lit("SUBTOTAL")).otherwise(F.col(lang)).alias(lang),
        "level",
        "records",
        "tokens",
    )


def unlabelled_tokens(df: DataFrame, group: str = "source", lang: str = "lang", tokens: str = "est_tokens") -> DataFrame:
    """Tokens of a source whose rows carry no language tag."""
    bare = F.coalesce(F.sum(F.when(F.coalesce(F.col(lang), F.lit("")) == "", F.col(tokens))), F.lit(0))
    sums = df.groupBy(group).agg(F.sum(tokens).alias("tokens"), bare.alias("unlabelled"))
    return sums.withColumn("unlabelled_pct", percent_of(F.col("unlabelled"), F.col("tokens")))


def value_counts(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Values by frequency, most common first; ties by value."""
    counted = df.groupBy(col(value).alias(name)).agg(F.count("*").alias("records"))
    return counted.orderBy(F.desc("records"), name)


def top_values(df: DataFrame, value: Column | str, n: int = 5, name: str = "value", approximate: bool = False) -> DataFrame:
    """The ``n`` most common values, each row with the number of distinct values."""
    counter = F.approx_count_distinct if approximate else F.countDistinct
    distinct = df.agg(counter(col(value))).scalar()
    return value_counts(df, value, name).limit(n).withColumn("distinct_values", distinct)


def parse_quality(unified: DataFrame, paired: str) -> DataFrame:
    """Records in all, paired records with both sides, and parse misses."""
    is_paired = F.col("source_dataset") == paired
    both = (F.coalesce("source_code", F.lit("")) != "") & (F.coalesce("llvm_ir", F.lit("")) != "")
    return unified.agg(
        F.count("*").alias("records"),
        F.count_if(is_paired & both).alias("both_fields"),
        F.count_if(is_paired & ~both).alias("parse_miss"),
    )


def first_per_group(df: DataFrame, n: int, group: str, order: Sequence[str], key: str) -> DataFrame:
    """First ``n`` records of each group with ``sample_no``.

    Ranks narrow rows (each task passes on at most ``n`` per group), then
    fetches the full records of the winners.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    narrow = df.select(*dict.fromkeys([group, key, *order])).withColumn("sample_no", rank)
    winners = materialize(narrow.filter(F.col("sample_no") <= n).select(key, "sample_no"))
    return df.join(broadcast_if_small(winners), key)


def dataset_totals(df: DataFrame, shard: Column, tokens: str = "est_tokens") -> DataFrame:
    return df.select(shard.alias("_shard"), tokens).agg(
        F.countDistinct("_shard").alias("shards"),
        F.count("*").alias("records"),
        F.sum(tokens).alias("tokens"),
    )


def meta_keys(df: DataFrame, group: str = "source", meta: str = "meta") -> DataFrame:
    """Metadata keys that occur in each source."""
    exploded = df.select(group, F.explode(F.map_keys(meta)).alias("meta_key"))
    return exploded.groupBy(group, "meta_key").agg(F.count("*").alias("records"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step, dropped rows and their share.

    Both sides are counted, not joined.
    """
    tagged = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    n = tagged.agg(
        F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("rows_after"),
    )
    dropped = F.col("rows_before") - F.col("rows_after")
    return n.select(
        "rows_before",
        "rows_after",
        dropped.alias("rows_dropped"),
        percent_of(dropped, F.col("rows_before")).alias("dropped_pct"),
    )


def require_rows(df: DataFrame, what: str = "blocks") -> DataFrame:
    """Raise when a step produced nothing."""
    if df.isEmpty():
        raise ValueError(f"the step produced 0 {what}")
    return df


def url_counts(df: DataFrame, url: Column | str) -> DataFrame:
    """Record count of a web source, and how many distinct addresses it really has."""
    return df.agg(F.count("*").alias("records"), F.countDistinct(col(url)).alias("distinct_urls"))

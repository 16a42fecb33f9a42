"""Near-duplicate removal: signatures, buckets, clusters, survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.ngrams import dedup_tokens
from millrace.operators.components import connected_components
from millrace.operators.minhash import NGRAM, NUM_PERM, THRESHOLD, band_keys, band_plan, signature
from millrace.session import join_unique_side, materialize, spread_small

HOT_ROWS = 1_000_000


def signatures(
    df: DataFrame,
    key: str,
    text: str,
    num_perm: int = NUM_PERM,
    ngram: int = NGRAM,
    min_tokens: int = NGRAM,
    short: str = "collapse",
) -> DataFrame:
    """(id, signature, digest) per document; equal signatures have equal digests of 16 bytes.

    Documents with fewer than ``min_tokens`` tokens have no n-grams.  By
    default they share the all-ones signature and so end up as one cluster;
    ``short="keep"`` or ``"drop"`` leaves them out of the comparison (see
    :func:`without_near_duplicates` for what happens to them then).
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    if short != "collapse":
        rows = rows.filter(F.size(dedup_tokens("_text")) >= max(ngram, min_tokens))
    signed = spread_small(rows).select("id", signature(F.col("_text"), num_perm, ngram, min_tokens).alias("signature"))
    return signed.withColumn("digest", F.unhex(F.md5("signature")))


def signature_groups(sigs: DataFrame) -> DataFrame:
    """One row per distinct signature: its smallest id.

    Documents with equal signatures share every band.  Collapsing them first
    keeps a text copied a billion times out of the buckets; the aggregate
    combines on the map side.
    """
    return sigs.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("signature").alias("signature")
    )


def band_members(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, key, id) for every representative."""
    exploded = reps.select(
        F.col("rep").alias("id"), F.posexplode(band_keys(F.col("signature"), bands, rows)).alias("band", "key")
    )
    return exploded.select("band", "key", "id")


def buckets(members: DataFrame) -> DataFrame:
    """Buckets with more than one id: size and smallest id."""
    grouped = members.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("id").alias("low"))
    return grouped.filter(F.col("members") > 1)


def bucket_edges(members: DataFrame, hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Star edges from each bucket member to the smallest id of its bucket.

    Linear in the bucket size, and hot buckets are split off.
    """
    linked = join_unique_side(members, buckets(members), ["band", "key"], "members", hot_rows, rows)
    return linked.filter(F.col("id") > F.col("low")).select(F.col("id").alias("src"), F.col("low").alias("dst")).distinct()


def copy_edges(sigs: DataFrame, groups: DataFrame, hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Edges from every further document of a signature to its smallest id."""
    repeated = groups.filter(F.col("copies") > 1)
    linked = join_unique_side(
        sigs.select("id", "digest"), repeated.select("digest", "rep", "copies"), ["digest"], "copies", hot_rows, rows
    )
    return linked.filter(F.col("id") > F.col("rep")).select(F.col("id").alias("src"), F.col("rep").alias("dst"))


def near_duplicate_clusters(
    df: DataFrame,
    key: str,
    text: str,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    ngram: int = NGRAM,
    min_tokens: int = NGRAM,
    short: str = "collapse",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, cluster) for every document that has a near duplicate; cluster is the smallest id."""
    bands, rows = band_plan(threshold, num_perm)
    sigs = materialize(signatures(df, key, text, num_perm, ngram, min_tokens, short))
    groups = materialize(signature_groups(sigs))
    members = materialize(band_members(groups, bands, rows))
    # Components run over representatives only; copies take their representative's cluster after.
    linked = connected_components(bucket_edges(members, hot_rows, members.count()), hot_rows=hot_rows)
    linked = materialize(linked)
    copies = copy_edges(sigs, groups, hot_rows, sigs.count())
    moved = copies.join(linked.withColumnRenamed("id", "dst"), "dst", "left").select(
        F.col("src").alias("id"), F.coalesce("cluster", "dst").alias("cluster")
    )
    lonely = groups.filter(F.col("copies") > 1).select(F.col("rep").alias("id")).join(linked, "id", "left_anti")
    return linked.unionByName(moved).unionByName(lonely.withColumn("cluster", F.col("id")))


def without_near_duplicates(
    df: DataFrame, key: str, text: str, clusters: DataFrame | None = None, short: str = "collapse", **options
) -> DataFrame:
    """Documents that are the smallest id of their cluster, or in none.

    ``short="keep"`` keeps every document too short to compare, ``"drop"``
    removes them all, ``"collapse"`` keeps the first of them.
    """
    if short not in ("collapse", "keep", "drop"):
        raise ValueError(f"unknown treatment of short documents {short!r}")
    if clusters is None:
        clusters = near_duplicate_clusters(df, key, text, short=short, **options)
    if short == "drop":
        need = max(options.get("ngram", NGRAM), options.get("min_tokens", NGRAM))
        df = df.filter(F.size(dedup_tokens(text)) >= need)
    removed = clusters.filter(F.col("id") != F.col("cluster")).select(F.col("id").alias(key))
    return df.join(removed, key, "left_anti")

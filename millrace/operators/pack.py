"""Token sequences to fixed-length blocks, and block splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.encoders import Encoder
from millrace.functions.keys import order_hash, unit_hash
from millrace.operators.budget import budget_cuts
from millrace.operators.prefix import ROWS_PER_BUCKET, hash_bucket, range_bounds, range_bucket

BATCH_RECORDS = 5_000
# A bucket is sorted in one task: at most about 64 MB of ids, or one document.
TOKENS_PER_BUCKET = 1 << 24
SPLIT_SEED = 42


def encode_documents(df: DataFrame, text: str, encoder: Encoder, keep: Sequence[str]) -> DataFrame:
    """``input_ids`` with the separator appended, and the columns in ``keep``."""
    return df.select(*keep, encoder.with_separator(text).alias("input_ids"))


def _pieces(rows: DataFrame, unit: Sequence[str], block_size: int) -> DataFrame:
    """Cut each document where its span ``[start, start + n)`` crosses a block border.

    Column expressions only: they keep the rows' partitioning, and the numbers of
    the blocks are multiplied, of which each takes its piece.
    """
    start, size = F.col("_start"), F.size("input_ids")
    last = F.floor((start + size - 1) / block_size)
    blocks = F.when(size > 0, F.sequence(F.floor(start / block_size), last))
    spread = rows.select(*unit, "_start", "input_ids", F.explode(blocks).alias("_block"))
    at = F.greatest(F.col("_block") * block_size, start)
    length = F.least((F.col("_block") + 1) * block_size, start + size) - at
    piece = F.slice("input_ids", (at - start + 1).cast("int"), length.cast("int"))
    return spread.select(*unit, "_block", at.alias("_at"), piece.alias("_ids"))


def _collect(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_ids")))
    return (
        pieces.groupBy(*keys)
        .agg(ordered.alias("_parts"))
        .select(
            *keys,
            F.col("_parts")[0]["_at"].alias("_at"),
            F.flatten(F.transform("_parts", lambda p: p["_ids"])).alias("_ids"),
        )
    )


def _running(order: str, unit: str, start: Column, value: Column) -> Column:
    inside = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return start + F.coalesce(F.sum(value).over(inside), F.lit(0))


def pack_blocks(
    encoded: DataFrame,
    order: str,
    block_size: int,
    scope: str = "global",
    batch_records: int = BATCH_RECORDS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hashed: bool = False,
    tokens_per_bucket: int = TOKENS_PER_BUCKET,
) -> DataFrame:
    """Concatenate ``input_ids`` in ``order`` and cut them into blocks; the tail is dropped.

    ``scope="global"`` treats the table as one stream, ``"batch"`` restarts
    every ``batch_records`` records.  ``order`` is a unique column of numbers,
    text, dates or timestamps, taken in Spark's order of that type (numbers as
    text are ordered as text), or an evenly spread hash string with
    ``hashed=True``.  Ranges of it are bounded by rows and by tokens.  Runs
    several jobs while the result is put together.

    ``encoded`` is read more than once, lengths first: pass a stored table, not
    a slow encoder's plan.  Documents move once, to the bucket that holds their stretch of the order.
    Blocks inside a bucket are finished there; only the pieces at the bucket
    borders, at most two blocks per bucket, meet in a second small shuffle.
    """
    if scope not in ("global", "batch"):
        raise ValueError(f"unknown pack scope {scope!r}")
    if hashed:
        bucket = hash_bucket(order)
    else:
        size = F.size("input_ids")
        bounds = range_bounds(encoded, order, rows_per_bucket, weight=size, weight_per_bucket=tokens_per_bucket)
        bucket = range_bucket(order, bounds)
    rows = encoded.select(
        F.col(order), "input_ids", F.size("input_ids").cast("bigint").alias("_n"), bucket.alias("_bucket")
    )
    totals = rows.groupBy("_bucket").agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_tokens_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    # One row per bucket: at most 65,536 hash buckets or MAX_BUCKETS ranges.
    placed = rows.join(F.broadcast(offsets), "_bucket")
    if scope == "batch":
        row_no = _running(order, "_bucket", F.col("_rows_before"), F.lit(1))
        batched = placed.withColumn("batch", F.floor(row_no / batch_records).cast("bigint"))
        batched = batched.withColumn("_start", _running(order, "batch", F.lit(0), F.col("_n")))
        blocks = _collect(_pieces(batched, ["batch"], block_size), ["batch", "_block"])
        return blocks.filter(F.size("_ids") == block_size).select(
            "batch", F.col("_block").alias("block_id"), F.col("_ids").alias("input_ids")
        )
    placed = placed.withColumn("_start", _running(order, "_bucket", F.col("_tokens_before"), F.col("_n")))
    inner = _collect(_pieces(placed, ["_bucket"], block_size), ["_bucket", "_block"])
    whole = F.size("_ids") == block_size
    finished = inner.filter(whole).select("_block", "_ids")
    borders = _collect(inner.filter(~whole).drop("_bucket"), ["_block"]).filter(whole)
    return finished.unionByName(borders.select("_block", "_ids")).select(
        F.col("_block").alias("block_id"), F.col("_ids").alias("input_ids")
    )


def training_columns(blocks: DataFrame) -> DataFrame:
    """Add an all-ones attention mask and labels equal to the ids."""
    return blocks.withColumns(
        {
            "attention_mask": F.transform("input_ids", lambda _: F.lit(1)),
            "labels": F.col("input_ids"),
        }
    )


def pack_summary(blocks: DataFrame, block_size: int) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks")).withColumn("tokens", F.col("blocks") * block_size)


def _split_at(df: DataFrame, order: str, n: int, bucket: Column) -> Column:
    """``validation`` for the first ``n`` rows in ``order``, ``train`` for the rest."""
    if n <= 0:
        return F.lit("train")
    ones = df.select(order).withColumns({"_all": F.lit("all"), "_one": F.lit(1)})
    cut = budget_cuts(ones, n, "_all", order, "_one", "cross", bucket).first()
    if cut is None:
        return F.lit("train")
    return F.when(F.col(order) <= F.lit(cut["_cut"]), "validation").otherwise("train")


def split_random(
    df: DataFrame, key: str, fraction: float, seed: int = SPLIT_SEED, exact: bool = True, keys: DataFrame | None = None
) -> DataFrame:
    """Seeded train/validation split; ``exact`` holds out ``ceil(fraction * rows)`` rows.

    ``keys`` is a table of the same keys that is cheaper to read than ``df``.
    """
    if not exact:
        held_out = unit_hash(key, seed) < fraction
        return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))
    keyed = df.withColumn("_h", order_hash(key, seed))
    counted = keyed if keys is None else keys.withColumn("_h", order_hash(key, seed))
    n = math.ceil(fraction * counted.count())
    return keyed.withColumn("split", _split_at(counted, "_h", n, hash_bucket("_h"))).drop("_h")


def split_head(df: DataFrame, order: str, percent: float, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The first ``percent`` of the rows in ``order`` are validation, without a shuffle of rows."""
    n = round(df.count() * percent / 100)
    bucket = range_bucket(order, range_bounds(df, order, rows_per_bucket))
    return df.withColumn("split", _split_at(df, order, n, bucket))

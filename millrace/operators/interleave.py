"""Round-robin interleaving of subsets, with short subsets repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import hash_bucket, with_running_totals
from millrace.session import broadcast_if_small, join_null_safe, materialize

CHUNK = 10_000


def round_robin(
    df: DataFrame,
    subset: str,
    order: str,
    bucket: Column | None = None,
) -> DataFrame:
    """One row of each subset in turn until the longest subset ends.

    Subsets take turns in name order, null first; a subset that runs out starts over, so
    the result has (number of subsets) x (rows of the longest) rows.  Adds
    ``turn`` (round), ``subset_index`` and ``position`` (overall order).

    ``df`` should be narrow, an id column is enough: rows are repeated, and
    the text can be joined back by id.  Repetitions are produced in chunks
    spread over the cluster, so a one-row subset beside a huge one is no
    single-task explosion.
    """
    bucket = hash_bucket(order) if bucket is None else bucket
    numbered = with_running_totals(df, {"_i": F.lit(1)}, [order], bucket, [subset])
    sizes = df.groupBy(subset).agg(F.count("*").alias("_n"))
    every = Window.partitionBy()
    sizes = sizes.select(
        subset,
        "_n",
        F.max("_n").over(every).alias("_longest"),
        F.count("*").over(every).alias("_subsets"),
        (F.row_number().over(Window.orderBy(subset)) - 1).alias("subset_index"),
    )
    rows = join_null_safe(numbered, broadcast_if_small(materialize(sizes)), [subset])
    last_repeat = F.floor((F.col("_longest") - 1 - F.col("_i")) / F.col("_n"))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor(last_repeat / CHUNK))
    spread = (
        rows.withColumn("_last", last_repeat)
        .withColumn("_chunk", F.explode(chunks))
        .repartition(subset, "_i", "_chunk")
    )
    first = F.col("_chunk") * CHUNK
    repeats = F.sequence(first, F.least(F.col("_last"), first + CHUNK - 1))
    turns = spread.withColumn("_repeat", F.explode(repeats)).withColumn(
        "turn", F.col("_i") + F.col("_repeat") * F.col("_n")
    )
    return turns.select(
        *df.columns,
        "turn",
        "subset_index",
        (F.col("turn") * F.col("_subsets") + F.col("subset_index")).alias("position"),
    )

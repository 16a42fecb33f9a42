"""Token-level scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col
from millrace.operators.instruct import IGNORE


def next_token_hits(preds: Column | str, labels: Column | str, ignore_masked: bool = False) -> Column:
    """Per position whether the prediction equals the *next* label.

    Predictions lose their last position, labels their first.  Ignored labels
    are misses, or null with ``ignore_masked``.
    """
    shifted = F.slice(col(labels), 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    cut = F.slice(col(preds), 1, F.greatest(F.size(preds) - 1, F.lit(0)))

    def hit(p: Column, l: Column) -> Column:
        return F.when(l != IGNORE, p == l) if ignore_masked else p == l

    return F.zip_with(cut, shifted, hit)


def token_accuracy(df: DataFrame, preds: str = "preds", labels: str = "labels", ignore_masked: bool = False) -> DataFrame:
    """Share of positions whose prediction equals the next label.

    Ignored labels count as misses unless ``ignore_masked`` is set.  Counted
    per row, so one sum per task is shuffled.
    """
    hits = F.col("_hits")
    counted = F.filter(hits, lambda h: h.isNotNull()) if ignore_masked else hits
    scored = df.select(next_token_hits(preds, labels, ignore_masked).alias("_hits")).select(
        F.size(F.filter(hits, lambda h: h)).cast("bigint").alias("hits"),
        F.size(counted).cast("bigint").alias("positions"),
    )
    sums = scored.agg(F.sum("hits").alias("hits"), F.sum("positions").alias("positions"))
    return sums.withColumn("accuracy", F.when(F.col("positions") > 0, F.col("hits") / F.col("positions")))


def perplexity(df: DataFrame, loss: str = "loss") -> DataFrame:
    """Exponential of the mean loss; infinity where that overflows."""
    return df.agg(F.avg(loss).alias("mean_loss")).withColumn("perplexity", F.exp("mean_loss"))


def unmask(ids: Column | str, labels: Column | str, pad: int) -> Column:
    """Ids with the positions of ignored labels replaced by padding."""
    return F.zip_with(col(ids), col(labels), lambda i, l: F.when(l != IGNORE, i).otherwise(F.lit(pad)))

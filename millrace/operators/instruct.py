"""Prompt and response rows to label-masked training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.encoders import Encoder
from millrace.functions.text import col
from millrace.operators.prefix import ROWS_PER_BUCKET, range_bounds, range_bucket, with_running_totals

IGNORE = -100

# Section headers of the two prompt layouts.
INSTRUCTION_LAYOUT = ("### Instruction:\n", "\n\n### Response:\n")
DIFF_LAYOUT = ("### Diff:\n", "\n\n### Message:\n")


def prompt(text: Column | str, layout: tuple[str, str] = INSTRUCTION_LAYOUT) -> Column:
    return F.concat(F.lit(layout[0]), col(text), F.lit(layout[1]))


def response(text: Column | str, eos: str) -> Column:
    return F.concat(col(text), F.lit(eos))


def truncated(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def real_length(ids: Column, pad: int | None) -> Column:
    """Number of ids that are not padding."""
    return F.size(ids) if pad is None else F.size(F.filter(ids, lambda i: i != pad))


def masked_labels(ids: Column, prompt_length: Column) -> Column:
    """Labels equal to the ids, with the prompt part ignored."""
    return F.transform(ids, lambda i, pos: F.when(pos < prompt_length, F.lit(IGNORE)).otherwise(i))


def supervised_examples(
    df: DataFrame,
    key: str,
    ask: str,
    answer: str,
    encoder: Encoder,
    max_length: int,
    eos_text: str,
    layout: tuple[str, str] = INSTRUCTION_LAYOUT,
) -> DataFrame:
    """``input_ids`` and ``labels`` per row.

    The prompt is encoded and truncated on its own; its length there is what
    gets masked, so a prompt longer than ``max_length`` masks everything.
    """
    question = prompt(ask, layout)
    ids = truncated(encoder(F.concat(question, response(answer, eos_text))), max_length)
    asked = truncated(encoder(question), max_length)
    encoded = df.select(key, ids.alias("input_ids"), real_length(asked, encoder.pad).alias("_asked"))
    return encoded.select(key, "input_ids", masked_labels(F.col("input_ids"), F.col("_asked")).alias("labels"))


def padded_batches(
    df: DataFrame, order: str, batch_size: int, pad: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Pad each run of ``batch_size`` examples in ``order`` to its longest one.

    Batches and their lengths are found on (order, size); the arrays move once.
    """
    bucket = range_bucket(order, range_bounds(df, order, rows_per_bucket))
    sizes = df.select(order, F.size("input_ids").alias("_size"))
    numbered = with_running_totals(sizes, {"_i": F.lit(1)}, [order], bucket)
    batched = numbered.withColumn("batch", F.floor(F.col("_i") / batch_size).cast("bigint"))
    longest = F.max("_size").over(Window.partitionBy("batch"))
    planned = batched.select(order, "batch", (longest - F.col("_size")).alias("_missing"))
    sized = df.join(planned, order)

    def fill(c: str, value: int) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(value), F.col("_missing")))

    return sized.select(
        order,
        "batch",
        fill("input_ids", pad).alias("input_ids"),
        fill("labels", IGNORE).alias("labels"),
    ).withColumn("attention_mask", F.transform("input_ids", lambda i: (i != pad).cast("int")))

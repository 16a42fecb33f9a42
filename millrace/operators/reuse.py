"""Run repeated work once: one evaluation per distinct program."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col
from millrace.session import join_unique_side, materialize


def program_text(completion: Column | str, tests: Column | str) -> Column:
    return F.concat(col(completion), F.lit("\n"), col(tests))


def evaluate_once(
    df: DataFrame,
    program: str,
    evaluate: Callable[[DataFrame], DataFrame],
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Apply ``evaluate`` to the distinct programs and hand each result to all its rows.

    ``evaluate`` receives (``program_id``, program) and must keep
    ``program_id``.  Rows join on a digest, never on the text, and programs
    repeated more than ``hot_rows`` times do not meet in one task.
    """
    marked = df.withColumn("program_id", F.sha2(F.col(program), 256))
    distinct = marked.groupBy("program_id").agg(F.any_value(program).alias(program), F.count("*").alias("_uses"))
    distinct = materialize(distinct)
    results = evaluate(distinct.drop("_uses")).drop(program)
    sized = results.join(distinct.select("program_id", "_uses"), "program_id")
    return join_unique_side(marked, sized, ["program_id"], "_uses", hot_rows).drop("program_id")

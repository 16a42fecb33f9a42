"""Pass rates over outcome tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col
from millrace.operators.prefix import ROWS_PER_BUCKET, range_bounds, range_bucket, with_running_totals

KS = (1, 10, 25)


def explode_candidates(generations: DataFrame, task: str = "task_id", candidates: str = "candidates") -> DataFrame:
    """One row per candidate, numbered within its task."""
    return generations.select(task, F.posexplode(candidates).alias("completion_id", "completion"))


def candidate_programs(completions: DataFrame, tests: DataFrame, task: str = "task_id") -> DataFrame:
    """Each candidate followed by the test of its task, matched by key."""
    return completions.join(tests, task).withColumn("program", F.concat("completion", F.lit("\n"), "test"))


def task_tallies(outcomes: DataFrame, task: str = "task_id", passed: Column | str = "passed") -> DataFrame:
    return outcomes.groupBy(task).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(col(passed), F.lit(False))).alias("correct")
    )


def pass_at_k(total: Column | str, correct: Column | str, k: int) -> Column:
    """Chance that one of ``k`` draws without replacement passes."""
    n, c = col(total), col(correct)
    draws = F.array(*[F.lit(j) for j in range(k)])
    misses = F.aggregate(draws, F.lit(1.0), lambda acc, j: acc * (n - c - j) / (n - j))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - misses)


def mean_pass_at_k(tallies: DataFrame, ks: Sequence[int] = KS, every_task: bool = True) -> DataFrame:
    """Mean pass@k over tasks; null for a ``k`` that some task has too few candidates for."""
    means = []
    for k in ks:
        mean = F.avg(pass_at_k("total", "correct", k))
        means.append((F.when(F.min("total") >= k, mean) if every_task else mean).alias(f"pass_at_{k}"))
    return tallies.agg(*means)


def passed_run(status: Column | str = "status", exit_code: Column | str = "exit_code") -> Column:
    """A finished run counts as passed when its status is OK and it exited with 0."""
    return F.coalesce((col(status) == "OK") & (col(exit_code) == 0), F.lit(False))


def candidate_outcomes(
    runs: DataFrame,
    task: str = "task_id",
    candidate: str = "candidate",
    phase: str = "phase",
    status: str = "status",
    exit_code: str = "exit_code",
    order: str | None = None,
) -> DataFrame:
    """One row (task, candidate, status, exit_code) per candidate from its build and run rows.

    A failed build decides; after a good one the first failed run does, in
    ``order``; without failures the candidate is OK if it ran at all.  A
    candidate that was built and never run is an Exception.
    """
    built = F.col(phase) == "build"
    failed = ~F.coalesce((F.col(status) == "OK") & (F.col(exit_code) == 0), F.lit(False))
    place = F.struct(F.when(built, 0).otherwise(1), F.col(order) if order else F.lit(0))
    result = F.struct(F.col(status).alias("status"), F.col(exit_code).alias("exit_code"))
    folded = runs.groupBy(task, candidate).agg(
        F.min_by(result, F.when(failed, place)).alias("_failed"),
        F.min_by(result, F.when(~built, place)).alias("_ran"),
    )
    never = F.struct(F.lit("Exception").alias("status"), F.lit(None).cast("int").alias("exit_code"))
    return folded.select(task, candidate, F.coalesce("_failed", "_ran", never).alias("_out")).select(task, candidate, "_out.*")


def pass_at_k_of_runs(runs: DataFrame, task: str, first_task: object, ks: Sequence[int] = KS) -> DataFrame:
    """Pass@k from candidate outcomes; reported for each ``k`` up to the candidates of ``first_task``."""
    tallies = task_tallies(runs, task, passed_run())
    of_first = F.max(F.when(F.col(task) == first_task, F.col("total")))
    return tallies.agg(
        *[
            F.when(of_first >= k, F.avg(pass_at_k("total", "correct", k))).alias(f"pass_at_{k}")
            for k in ks
        ]
    )


def require_unique_seeds(problems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a (perturbation, task, seed) occurs twice."""
    repeated = problems.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"repeated {tuple(keys)}: {tuple(repeated[0])[:-1]}")
    return problems


def robust_pass(
    outcomes: DataFrame,
    perturbation: str = "perturbation_name",
    task: str = "task_id",
    seed: str = "seed",
    sample: str = "sample_id",
    passed: str = "passed",
) -> DataFrame:
    """Per perturbation: mean robust pass@1, and the variant that multiplies seed means.

    A sample index counts when every seed of the task has it and passes; it is
    divided by the number of samples of the task's first seed.
    """
    right = F.coalesce(F.col(passed), F.lit(False))
    unit = [perturbation, task]
    per_seed = outcomes.groupBy(*unit, seed).agg(
        F.count("*").alias("n"), F.avg(right.cast("double")).alias("rate")
    )
    # Seeds of one task are few; their rates are folded in seed order.
    rates = F.array_sort(F.collect_list(F.struct(seed, "n", "rate")))
    per_task = per_seed.groupBy(*unit).agg(F.count("*").alias("seeds"), rates.alias("_rates")).select(
        *unit,
        "seeds",
        F.col("_rates")[0]["n"].alias("first_n"),
        F.aggregate("_rates", F.lit(1.0), lambda a, r: a * r["rate"]).alias("rate_product"),
    )
    per_index = outcomes.groupBy(*unit, sample).agg(
        F.countDistinct(seed).alias("seen"), F.bool_and(right).alias("all_right")
    )
    solved = (
        per_index.join(per_task.select(*unit, "seeds"), unit)
        .filter((F.col("seen") == F.col("seeds")) & F.col("all_right"))
        .groupBy(*unit)
        .agg(F.count("*").alias("solved"))
    )
    scored = per_task.join(solved, unit, "left").withColumn(
        "share", F.coalesce("solved", F.lit(0)) / F.col("first_n")
    )
    return scored.groupBy(perturbation).agg(
        F.avg("share").alias("robust_pass_at_1"), F.avg("rate_product").alias("alt_robust_pass_at_1")
    )


def number_samples(
    outcomes: DataFrame, unit: Sequence[str], order: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Number the attempts of each unit from 0 in ``order``; a unit may be of any size."""
    bucket = range_bucket(order, range_bounds(outcomes, order, rows_per_bucket))
    return with_running_totals(outcomes, {"sample_id": F.lit(1)}, [order], bucket, unit)

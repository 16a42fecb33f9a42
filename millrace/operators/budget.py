"""Token budgets: gates, availability, balanced allocation, and the mix report."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.keys import order_hash
from millrace.operators.prefix import hash_bucket
from millrace.session import broadcast_if_small, join_null_safe, materialize
from millrace.sources.readers import footer_count

#: One budget for every group, budgets by name, or a table (group, target).
Targets = Mapping[str, int] | int | DataFrame
SAMPLE_ROWS = 200


def targets_table(df: DataFrame, targets: Mapping[str, int], group: str = "source") -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(k, int(v)) for k, v in targets.items()], f"`{group}` string, target_tokens bigint"
    )


def with_target(df: DataFrame, targets: Targets, group: str = "source", name: str = "_target") -> DataFrame:
    """Rows of ``df`` whose group has a positive budget, with that budget.

    Budgets are joined as a table, broadcast after its size is checked, so that
    neither the plan nor the cost per row grows with the number of groups.
    """
    if isinstance(targets, int):
        return df.withColumn(name, F.lit(targets).cast("bigint")).filter(F.col(name) > 0)
    table = targets if isinstance(targets, DataFrame) else targets_table(df, targets, group)
    value = next(c for c in table.columns if c != group)
    funded = table.select(F.col(group), F.col(value).cast("bigint").alias(name)).filter(F.col(name) > 0)
    return join_null_safe(df, broadcast_if_small(funded), [group])


def budget_cuts(
    df: DataFrame,
    targets: Targets,
    group: str = "source",
    order: str = "order_key",
    tokens: str = "est_tokens",
    mode: str = "cross",
    bucket: Column | None = None,
) -> DataFrame:
    """One row per group: the last order key that still fits its budget.

    ``cross`` keeps rows while the sum of the preceding ones is below the
    target, so the crossing row stays.  ``floor`` keeps rows whose inclusive
    sum is at most the target, and at least the first row of the group.

    The narrow rows (group, order key, tokens) are written once, so that tokens
    derived from text are derived once.  Totals per (group, bucket) find the
    bucket where the budget runs out, then only that bucket of each group is
    walked row by row.  No text is shuffled and no task sees more than one
    bucket of a group.
    """
    if mode not in ("cross", "floor"):
        raise ValueError(f"unknown budget mode {mode!r}")
    bucket = hash_bucket(order) if bucket is None else bucket
    rows = df.select(
        F.col(group),
        F.col(order),
        F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("_n"),
        bucket.alias("_bucket"),
    )
    rows = materialize(with_target(rows, targets, group))

    totals = rows.groupBy(group, "_bucket").agg(
        F.sum("_n").alias("_sum"),
        F.max("_target").alias("_target"),
        F.min(order).alias("_low"),
        F.max(order).alias("_high"),
    )
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group,
        "_bucket",
        "_target",
        "_low",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.max("_high").over(earlier).alias("_last_key"),
    )
    reached = F.col("_before") < F.col("_target")
    if mode == "floor":
        reached = F.col("_before") <= F.col("_target")
    edge = offsets.groupBy(group).agg(
        F.max_by(
            F.struct("_bucket", "_before", "_last_key"), F.when(reached, F.col("_bucket"))
        ).alias("_edge"),
        F.min("_low").alias("_first_key"),
    )
    edge = materialize(edge.select(group, "_first_key", "_edge.*"))

    walked = join_null_safe(rows, broadcast_if_small(edge.drop("_first_key", "_last_key")), [group, "_bucket"])
    inside = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    fits = before < F.col("_target") if mode == "cross" else before + F.col("_n") <= F.col("_target")
    last_fit = (
        walked.select(group, order, fits.alias("_fits"))
        .filter("_fits")
        .groupBy(group)
        .agg(F.max(order).alias("_fit_key"))
    )
    cut = F.coalesce("_fit_key", "_last_key", "_first_key")
    return join_null_safe(edge, last_fit, [group], "left").select(group, cut.alias("_cut"))


def within_budget(
    df: DataFrame,
    targets: Targets,
    group: str = "source",
    order: str = "order_key",
    tokens: str = "est_tokens",
    mode: str = "cross",
    bucket: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` inside their group's token budget, in ``order``.

    The result is a map-side filter: ``df`` joined with one broadcast row per
    group, the size of which is checked first.  Rows of a null group are a
    group of their own.  Runs several jobs while the result is put together.
    """
    cuts = materialize(budget_cuts(df, targets, group, order, tokens, mode, bucket))
    return up_to_cut(df, cuts, group, order)


def up_to_cut(df: DataFrame, cuts: DataFrame, group: str = "source", order: str = "order_key", keep: Column | None = None) -> DataFrame:
    """Rows up to their group's cut key; ``cuts`` is a stored result of :func:`budget_cuts`.

    ``keep`` is a further, costly condition: it is looked at for rows up to the
    cut only, as part of one expression that cannot move before the join.
    """
    below = F.col(order) <= F.col("_cut")
    wanted = below if keep is None else F.when(below, keep).otherwise(F.lit(False))
    return join_null_safe(df, broadcast_if_small(cuts), [group]).filter(wanted).select(*df.columns)


def fraction_targets(total: int, fractions: Mapping[str, float], tolerance: float = 1e-3) -> dict[str, int]:
    """Integer budgets from shares of a total; warns when the shares do not sum to one."""
    whole = sum(fractions.values())
    if abs(whole - 1.0) > tolerance:
        warnings.warn(f"source fractions sum to {whole}, not 1.0", stacklevel=2)
    return {name: int(total * share) for name, share in fractions.items()}


def availability(
    df: DataFrame,
    group: str,
    key: str,
    tokens: str,
    valid: Column,
    seed: int,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Tokens each group can supply: row count times the mean of a small sample.

    The sample is the first ``sample_rows`` rows by seeded hash.  Invalid rows
    count as rows and are left out of the mean.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("n_rows"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h"))
    sample = (
        df.select(group, order_hash(key, seed).alias("_h"), F.when(valid, F.col(tokens)).alias("_n"))
        .withColumn("_r", rank)
        .filter(F.col("_r") <= sample_rows)
        .groupBy(group)
        .agg(F.coalesce(F.avg("_n"), F.lit(0.0)).alias("avg_tokens"))
    )
    return join_null_safe(counts, sample, [group]).withColumn(
        "available", F.floor(F.col("n_rows") * F.col("avg_tokens")).cast("bigint")
    )


def availability_of_files(
    spark: SparkSession,
    files: Mapping[tuple[str, ...], Sequence[str]],
    group: Sequence[str],
    tokens: Column,
    valid: Column,
    files_per_group: int = 1,
) -> DataFrame:
    """Tokens each group of files can supply, from a probe of its first files.

    Only the probed files are opened beyond their footers; row counts of all come
    from footers.  ``files`` lists each group's files in path order.  Beside the
    mean of the valid rows stands its standard error, and how many rows it has.
    """
    probed = [f for names in files.values() for f in list(names)[:files_per_group]]
    schema = ", ".join(f"`{g}` string" for g in group)
    counted = [(*name, footer_count(spark, names).first()[0], list(names)[:files_per_group]) for name, names in files.items()]
    groups = spark.createDataFrame(counted, f"{schema}, n_rows bigint, probed array<string>")

    def plain(path: Column) -> Column:
        # listings and scans write the slashes behind the scheme differently
        return F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")

    owners = groups.select(*group, F.explode("probed").alias("_file")).withColumn("_file", plain(F.col("_file")))
    if not probed:
        return groups.drop("probed").select("*", *[F.lit(0.0).alias(c) for c in ("avg_tokens", "error")], *[F.lit(0).cast("bigint").alias(c) for c in ("probed_rows", "available")])
    rows = spark.read.parquet(*probed).select(plain(F.col("_metadata.file_path")).alias("_file"), F.when(valid, tokens).alias("_n"))
    # one row per probed file, bounded by groups times files of each
    sums = rows.join(F.broadcast(owners), "_file").groupBy(*group).agg(
        F.count("_n").alias("probed_rows"), F.coalesce(F.avg("_n"), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.stddev_samp("_n") / F.sqrt(F.count("_n")), F.lit(0.0)).alias("error"),
    )
    whole = join_null_safe(groups.drop("probed"), sums, list(group), "left").fillna(0, ["probed_rows", "avg_tokens", "error"])
    return whole.withColumn("available", F.floor(F.col("n_rows") * F.col("avg_tokens")).cast("bigint"))


def balanced_targets(avail: DataFrame, group: str, total: int, available: str = "available") -> DataFrame:
    """(group, target_tokens): equal shares, where no group gets more than it has.

    With groups in order of what they have, prefix sums give the level at which
    ``total`` would be spent if every group from here on got that level; the
    groups that have less than the level of their place are full, and the first
    one that has not sets the level of all the rest.  Levels are rounded down:
    fewer tokens than groups stay unspent.  If ``total`` exceeds all that there
    is, the surplus is added evenly, since availability is an estimate.
    One window over the table of groups; nothing is collected.
    """
    have = F.greatest(F.coalesce(F.col(available), F.lit(0)), F.lit(0)).cast("bigint")
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("_have", F.col(group).asc_nulls_first())
    placed = avail.select(F.col(group), have.alias("_have")).select(
        "*",
        F.coalesce(F.sum("_have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.count("*").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_rest"),
        F.sum("_have").over(everything).alias("_sum"),
        F.count("*").over(everything).alias("_groups"),
    )
    level = F.floor((F.lit(total) - F.col("_before")) / F.col("_rest")).cast("bigint")
    water = F.max(F.when(F.col("_have") > level, level)).over(everything)
    surplus = F.floor(F.greatest(F.lit(total) - F.col("_sum"), F.lit(0)) / F.col("_groups")).cast("bigint")
    return placed.withColumn("_water", water).select(
        group, (F.least(F.col("_have"), F.coalesce("_water", "_have")) + surplus).alias("target_tokens")
    )


def budget_report(written: DataFrame, targets: Mapping[str, int], group: str = "source", tokens: str = "est_tokens") -> DataFrame:
    """Target, written tokens and share per funded source, with a total row."""
    sums = written.groupBy(group).agg(F.sum(tokens).cast("bigint").alias("written_tokens"))
    planned = targets_table(written, {k: v for k, v in targets.items() if v > 0}, group)
    rolled = (
        planned.join(sums, group, "left")
        .fillna(0, ["written_tokens"])
        .rollup(group)
        .agg(
            F.sum("target_tokens").cast("bigint").alias("target_tokens"),
            F.sum("written_tokens").cast("bigint").alias("written_tokens"),
            F.grouping(group).alias("_total"),
        )
    )
    grand = F.max(F.when(F.col("_total") == 1, F.col("written_tokens"))).over(Window.partitionBy())
    share = F.when(grand > 0, F.col("written_tokens") * 100.0 / grand).otherwise(0.0)
    return rolled.select(
        F.when(F.col("_total") == 1, F.lit("TOTAL")).otherwise(F.col(group)).alias(group),
        "target_tokens",
        "written_tokens",
        share.alias("share_pct"),
    )

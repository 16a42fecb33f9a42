"""From raw sources to a budgeted mix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import order_hash
from millrace.functions.templates import pair_text
from millrace.functions.text import estimate_pair_tokens, first_present, has_text
from millrace.operators import budget, select
from millrace.operators.extract import (
    DEFAULT_LABELS,
    LANGUAGE_KEYS,
    PAIR_IR_KEYS,
    PAIR_SOURCE_KEYS,
    SourceSpec,
    extract,
)
from millrace.session import materialize


@dataclass(frozen=True)
class SourceInput:
    """A raw frame, how to read it, and the column that names its rows."""

    spec: SourceSpec
    frame: DataFrame
    key: str


def source_candidates(item: SourceInput, seed: int) -> DataFrame:
    """One source up to its length filter: language filter, subsample, extraction.

    The cheap filters on raw columns come first in the plan; the order key is
    a seeded shuffle of the source's own row ids.
    """
    spec, raw = item.spec, item.frame
    if spec.allowed_langs is not None:
        lang = first_present(raw, ("lang", "language"))
        raw = raw.filter(select.language_allowed(lang, spec.allowed_langs, code=spec.name != DEFAULT_LABELS.ir_only))
    if spec.keep_prob < 1.0:
        raw = raw.filter(select.sampled(item.key, seed, spec.keep_prob))
    docs = extract(raw, spec, F.col(item.key).cast("string"))
    # A row id is unique inside its source only; doc_key is unique in the mix.
    named = docs.withColumn("doc_key", F.concat_ws("/", "source", "key"))
    return named.withColumn("order_key", order_hash("doc_key", seed))


def source_documents(
    item: SourceInput,
    seed: int,
    low: int = select.MIN_TOKENS,
    high: int | None = None,
) -> DataFrame:
    """One source up to its gate."""
    return source_candidates(item, seed).filter(has_text("text") & select.within_length("est_tokens", low, high))


def build_mix(
    sources: Sequence[SourceInput],
    targets: Mapping[str, int],
    seed: int = 42,
    low: int = select.MIN_TOKENS,
    high: int | None = None,
    mode: str = "cross",
) -> DataFrame:
    """All funded sources, each cut at its token budget, as one table and one plan.

    Words are counted once per candidate, on the way to a narrow table from which
    the cuts follow; in the pass over the texts only rows up to the cut are
    counted again, for the length filter and the token column.
    """
    wanted = select.funded(targets)
    parts = [source_candidates(s, seed) for s in sources if s.spec.name in wanted]
    if not parts:
        raise ValueError("no source has a budget")
    union = reduce(DataFrame.unionByName, parts)
    counted = materialize(union.filter(has_text("text")).select("source", "order_key", "est_tokens"))
    long_enough = select.within_length("est_tokens", low, high)
    cuts = materialize(budget.budget_cuts(counted.filter(long_enough), wanted, mode=mode))
    return budget.up_to_cut(union, cuts, keep=has_text("text") & long_enough)


def group_key(*columns: str) -> Column:
    return F.concat_ws("/", *columns)


def balanced_pairs(
    raw: DataFrame,
    key: str,
    total: int,
    seed: int = 42,
    low: int = select.MIN_TOKENS,
    name: str = DEFAULT_LABELS.paired,
) -> DataFrame:
    """Paired source and IR, balanced over (language, IR type).

    Availability per group is probed on a small sample, the total is shared
    out evenly with redistribution, and every group is cut at its share.
    """
    rows = raw.select(
        F.col(key).cast("string").alias("key"),
        first_present(raw, PAIR_SOURCE_KEYS).alias("_src"),
        first_present(raw, PAIR_IR_KEYS).alias("_ir"),
        first_present(raw, LANGUAGE_KEYS).alias("language"),
        first_present(raw, ("ir_type",)).alias("ir_type"),
    ).withColumns(
        {
            "est_tokens": estimate_pair_tokens("_src", "_ir"),
            "group": group_key("language", "ir_type"),
            "order_key": order_hash("key", seed),
        }
    )
    valid = has_text("_src") & has_text("_ir")
    # the probe and the gate read what is counted here once
    counted = materialize(rows.select("key", "group", "order_key", "est_tokens", valid.alias("_valid")))
    avail = budget.availability(counted, "group", "key", "est_tokens", F.col("_valid"), seed)
    usable = F.col("est_tokens") >= low
    cuts = materialize(
        budget.budget_cuts(
            counted.filter(F.col("_valid") & usable), budget.balanced_targets(avail, "group", total), group="group", mode="floor"
        )
    )
    kept = budget.up_to_cut(rows.filter(valid & usable), cuts, "group")
    return kept.select(
        "key",
        pair_text("_src", "_ir").alias("text"),
        F.lit(name).alias("source"),
        F.create_map(F.lit("language"), "language", F.lit("ir_type"), "ir_type").alias("meta"),
        "est_tokens",
        "order_key",
    )


def manifest(
    written: DataFrame,
    targets: Mapping[str, int],
    seed: int,
    low: int = select.MIN_TOKENS,
    high: int | None = None,
) -> DataFrame:
    """One row describing a run: seed, length filter, and per source target and tokens written."""
    report = budget.budget_report(written, targets).filter(F.col("source") != "TOTAL")
    per_source = F.struct("source", "target_tokens", "written_tokens")
    return report.agg(F.array_sort(F.collect_list(per_source)).alias("sources")).select(
        F.lit(seed).alias("seed"),
        F.lit(low).alias("min_tokens_per_record"),
        F.lit(high).cast("int").alias("max_tokens_per_record"),
        "sources",
        F.aggregate("sources", F.lit(0).cast("bigint"), lambda a, s: a + s["written_tokens"]).alias("tokens_written"),
    )

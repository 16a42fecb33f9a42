"""All named queries in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import profile, select
from millrace.operators.budget import within_budget
from millrace.plans import dedup, evaluation, live, mixing, packing, registry, reports, scoring, storage
from millrace.plans.registry import QueryFn

MODULES = (reports, mixing, packing, dedup, scoring, evaluation, live, storage)


def queries() -> dict[str, QueryFn]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.mixed_documents(spark, sf_dir).filter(select.within_length())
    kept = within_budget(docs.drop("text", "meta"), 20_000)
    return profile.source_profile(kept)

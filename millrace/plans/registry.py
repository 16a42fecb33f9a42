"""Named queries over the standard tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import order_hash
from millrace.functions.text import estimate_tokens

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name, with its checking SQL if there is one."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the token estimate in place of the text."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", estimate_tokens("text").alias("est_tokens")
    )


def mixed_documents(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """documents as the mixed record with a seeded order key."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        order_hash("doc_id", seed).alias("order_key"),
        "text",
        "source",
        "lang",
        F.create_map(F.lit("lang"), "lang", F.lit("id"), F.col("doc_id").cast("string")).alias("meta"),
        estimate_tokens("text").alias("est_tokens"),
    )


def joined(ids: Column | str) -> Column:
    """Array of numbers as text, for results that are compared by value."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


# The same expressions in the checking SQL.
def sql_words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def sql_tokens(text: str) -> str:
    return f"CAST(trunc({sql_words(text)} * 1.5) AS BIGINT)"


def sql_order(key: str, seed: int) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def sql_unit(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr({sql_order(key, seed)}, 1, 8)) AS BIGINT) / 4294967296.0)"


TOKEN_DOCS = f"docs AS (SELECT doc_id, source, lang, text, {sql_tokens('text')} AS est_tokens FROM documents)"

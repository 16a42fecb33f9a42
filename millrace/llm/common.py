"""Shared pieces of the operators: reading tables, mapping texts in Arrow batches, run tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: T.StructType | str) -> DataFrame:
    """One output row per input row: ``fn(*columns) -> tuple`` inside Arrow batches, no shuffle."""
    return flat_map_rows(df, lambda *row: (fn(*row),), schema)


def flat_map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: T.StructType | str) -> DataFrame:
    """Any number of output rows per input row, inside Arrow batches, no shuffle."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in fn(*row)]
            columns = zip(*rows) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)

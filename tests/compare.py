"""Compare a Spark result with the checking SQL: names, types, rows, values."""

from __future__ import annotations

import glob
import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    expected_names = rel.columns
    if sorted(spark_df.columns) != sorted(expected_names):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_names)}"
    kinds = {"LongType()": "BIGINT", "StringType()": "VARCHAR", "DoubleType()": "DOUBLE", "BooleanType()": "BOOLEAN", "IntegerType()": "INTEGER"}
    sql_types = dict(zip(rel.columns, map(str, rel.types)))
    for f in spark_df.schema:
        if kinds.get(str(f.dataType)) != sql_types[f.name]:
            return f"type of {f.name}: {f.dataType} != {sql_types[f.name]}"
    got = _normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    want = _normal(rel.fetchall(), expected_names)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"\n  got  {str(g)[:600]}\n  want {str(w)[:600]}"
    return None

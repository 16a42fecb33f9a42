"""Order keys of every type behave alike whether or not the table is cut into ranges."""

import datetime as dt
import random

import pytest
from millrace.operators import pack, passk, prompts
from millrace.operators.prefix import range_bounds, range_bucket, with_running_totals
from pyspark.sql import functions as F

KINDS = {
    "bigint": lambda i: i * 7 - 500,
    "double": lambda i: (i - 60) / 7,
    "string": lambda i: f"k{i * 37 % 1000:04d}\n{i}",
    "date": lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i),
    "timestamp": lambda i: dt.datetime(2024, 3, 30) + dt.timedelta(minutes=37 * i),
    "decimal(12,3)": lambda i: __import__("decimal").Decimal(i * 13) / 8,
}


def table(spark, kind, n=200, seed=4):
    rng = random.Random(seed)
    rows = [(KINDS[kind](i), [i] * rng.choice([0, 1, 3, 20])) for i in rng.sample(range(n), n)]
    return rows, spark.createDataFrame(rows, f"k {kind}, input_ids array<int>").repartition(4)


@pytest.mark.parametrize("kind", KINDS)
def test_buckets_are_monotone_and_even(spark, kind):
    _, df = table(spark, kind)
    marked = df.select("k", range_bucket("k", range_bounds(df, "k", 20)).alias("b"))
    found = marked.groupBy("b").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).orderBy("b").collect()
    assert len(found) >= 8 and max(r.n for r in found) < 60
    assert all(a.high < b.low for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("rows_per_bucket", [15, 100_000])
def test_packing_follows_the_key(spark, kind, rows_per_bucket):
    rows, df = table(spark, kind)
    flat = [x for _, ids in sorted(rows, key=lambda r: r[0]) for x in ids]
    got = pack.pack_blocks(df, "k", 16, rows_per_bucket=rows_per_bucket).orderBy("block_id").collect()
    assert [r.input_ids for r in got] == [flat[i : i + 16] for i in range(0, len(flat) // 16 * 16, 16)]


def test_buckets_are_bounded_by_tokens(spark):
    _, df = table(spark, "bigint")
    bounds = range_bounds(df, "k", 10**6, weight=F.size("input_ids"), weight_per_bucket=100)
    assert len(bounds.values) >= 8


def test_other_types_are_refused_at_any_size(spark):
    df = spark.createDataFrame([([1],)], "k array<int>")
    with pytest.raises(ValueError, match="cannot be cut"):
        range_bounds(df, "k")


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a", 1) for i in range(30)], "k long, g string, v long")
    rows = with_running_totals(df, {"before": "v"}, ["k"], range_bucket("k", range_bounds(df, "k", 5)), ["g"]).collect()
    for name in ("a", None):
        mine = sorted((r.k, r.before) for r in rows if r.g == name)
        assert [b for _, b in mine] == list(range(len(mine))) and mine
    numbered = passk.number_samples(df, ["g"], "k", rows_per_bucket=4)
    assert numbered.count() == 30
    assert prompts.numbered_batches(df.select(F.col("k").cast("string")), "k", 7, rows_per_bucket=4).count() == 30


def test_candidate_outcomes(spark):
    runs = [
        ("t", 1, "build", "OK", 0, 1), ("t", 1, "run", "Exception", 1, 2),
        ("t", 2, "build", "SyntaxError", 1, 1), ("t", 2, "run", "OK", 0, 2),
        ("t", 3, "build", "OK", 0, 1), ("t", 3, "run", "OK", 0, 2),
        ("t", 4, "build", "OK", 0, 1), ("t", 5, "run", "Timeout", None, 1), ("t", 6, "run", "OK", 0, 1),
    ]
    df = spark.createDataFrame(runs, "task_id string, candidate long, phase string, status string, exit_code int, n long")
    got = {r.candidate: r.status for r in passk.candidate_outcomes(df, order="n").collect()}
    assert got == {1: "Exception", 2: "SyntaxError", 3: "OK", 4: "Exception", 5: "Timeout", 6: "OK"}
    assert passk.pass_at_k_of_runs(passk.candidate_outcomes(df, order="n"), "task_id", "t", (1,)).first()[0] == pytest.approx(2 / 6)


def test_pass_at_k_of_many_candidates(spark):
    df = spark.createDataFrame([(10_000_000, 9_000_000), (5, 5), (5, 0), (10, 3)], "n long, c long")
    got = [r[0] for r in df.select(passk.pass_at_k("n", "c", 2)).collect()]
    assert got == pytest.approx([0.99, 1.0, 0.0, 1 - 42 / 90], abs=1e-6)

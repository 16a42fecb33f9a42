"""Values, groups and slices of any size: readers, writers and selections that no single task carries."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import budget, interleave, select
from millrace.sources import readers, writers


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few dozen bytes, so that files are cut inside strings and escapes."""
    settings = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def flat(value):
    return sorted((t, c, text) for t, task in enumerate(value) for c, text in enumerate(task))


def odd_lists(rng):
    pieces = ['"', "\\", "[", "]", ",", "],[", "\n", "é", "🙂", "a", "x y", '\\"', "", "\t", "{}"]
    return [["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False}])
def test_generations_cut_anywhere(spark, tmp_path, small_ranges, style):
    value = odd_lists(random.Random(len(style)))
    path = tmp_path / "g.json"
    path.write_text(json.dumps(value, **style), encoding="utf-8")
    assert len(spark.read.option("lineSep", '"').text(str(path)).rdd.glom().collect()) > 1
    assert sorted(map(tuple, readers.read_generations(spark, str(path)).collect())) == flat(value)
    assert sorted(map(tuple, readers.read_generations(spark, str(path), 2).collect())) == flat(value[:2])


def test_files_are_told_apart(spark, tmp_path):
    values = {"a": [["x", 'y"z'], []], "b": [[], [], ["u"]], "c": [], "d": [[]]}
    for name, value in values.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = readers.read_generations(spark, str(tmp_path), file="file").collect()
    assert sorted((r.file[-6], r.task_id, r.completion_id, r.completion) for r in got) == [
        ("a", 0, 0, "x"), ("a", 0, 1, 'y"z'), ("b", 2, 0, "u"),
    ]


@pytest.mark.parametrize("text", ['[["a", 1]]', '[["a", null]]', '[["a", "b]]'])
def test_other_values_are_errors(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(Exception):
        readers.read_generations(spark, str(tmp_path / "g.json")).collect()


def test_candidates_of_any_number(spark, tmp_path):
    rows = [("big", i, f'line {i}\n"quoted" [{i}] \\') for i in range(20_000)] + [("one", 0, None), ("two", 3, "b"), ("two", 1, "a"), (None, 0, "x")]
    path = str(tmp_path / "c")
    writers.write_candidates(spark.createDataFrame(rows, "task_id string, completion_id int, completion string"), path)
    back = [tuple(r) for r in readers.read_candidate_lines(spark, path).collect()]
    want = [*rows[:20_000], ("one", 0, None), ("two", 0, "a"), ("two", 1, "b"), (None, 0, "x")]
    assert sorted(back, key=str) == sorted(want, key=str)
    # no row, and so no task, holds all candidates
    lines = spark.read.option("lineSep", " ").text(path)
    assert lines.agg(F.max(F.length("value"))).first()[0] < 200


def test_results_of_any_number(spark, tmp_path):
    runs = spark.createDataFrame([("t", i, f"p{i}", "OK") for i in range(5_000)] + [("gone", 0, "z", "OK")], "task_id string, completion_id int, program string, status string")
    problems = spark.createDataFrame([("t", 'say "x"', ["c"]), ("none", "q", None)], "task_id string, prompt string, completions array<string>")
    writers.write_problem_results(problems, runs, str(tmp_path / "r"))
    rows = spark.read.json(str(tmp_path / "r")).collect()
    assert [(r.task_id, r.prompt, len(r.results)) for r in rows] == [("t", 'say "x"', 5_000)]
    assert [x.program for x in rows[0].results] == [f"p{i}" for i in range(5_000)]


def test_predictions_in_order(spark, tmp_path):
    rows = [(i, f"text {i}\nmore") for i in range(200)]
    random.Random(1).shuffle(rows)
    writers.write_predictions(spark.createDataFrame(rows, "n int, t string").repartition(5), "t", str(tmp_path / "p"), order="n")
    whole = "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*")))
    assert whole.split(writers.PREDICTION_DELIMITER)[:-1] == [f"text {i}\nmore" for i in range(200)]


def test_exact_shards(spark, tmp_path):
    df = spark.range(57).select(
        F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") < 50, "a").otherwise("b").alias("source"),
        F.create_map(F.lit("k"), F.lit("v")).alias("meta"), F.col("id").alias("est_tokens"), ((F.col("id") * 37) % 57).alias("key"),
    )
    writers.write_shards(df.repartition(6), str(tmp_path / "s"), 8, order="key")
    sizes = {}
    for f in sorted((tmp_path / "s").rglob("*.json")):
        sizes.setdefault(f.parts[-3], []).append(len(f.read_text().splitlines()))
    assert {k: sorted(v) for k, v in sizes.items()} == {"_folder=a": [2, *[8] * 6], "_folder=b": [7]}
    back = readers.read_shards(spark, str(tmp_path / "s"))
    assert sorted(r.text for r in back.collect()) == sorted(f"t{i}" for i in range(57))


def slices(rows, order, start, n):
    ordered = sorted(rows, key=lambda r: [(r[k] is not None, r[k]) for k in order])
    return ordered[max(0, start) :][:n]


@pytest.mark.parametrize("rows_per_bucket", [7, 200_000])
def test_slices_of_many_keys(spark, rows_per_bucket):
    rng = random.Random(2)
    rows = [{"a": rng.choice([None, "x", "y", "z'q"]), "b": rng.choice([None, 1.5, 2.5]), "c": i} for i in range(120)]
    df = spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in rows], "a string, b double, c bigint").repartition(4)
    for start, n in ((0, 10), (13, 50), (110, 40), (0, None), (40, None), (200, 5), (5, 0), (0, 120), (-3, 4), (60, 1)):
        got = select.ordered_slice(df, ["a", "b", "c"], start, n, rows_per_bucket)
        assert sorted(r.c for r in got.collect()) == sorted(r["c"] for r in slices(rows, ["a", "b", "c"], start, n)), (start, n)


def test_slices_of_repeated_keys(spark):
    df = spark.createDataFrame([(i // 40,) for i in range(120)], "k int").repartition(3)
    for start, n, want in ((0, 30, {0: 30}), (30, 20, {0: 10, 1: 10}), (50, 10, {1: 10}), (39, 42, {0: 1, 1: 40, 2: 1}), (100, 50, {2: 20}), (110, None, {2: 10})):
        got = select.ordered_slice(df, ["k"], start, n).groupBy("k").count().collect()
        assert {r[0]: r[1] for r in got} == want


def test_slices_move_no_rows(spark):
    df = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), "id")
    for out in (select.ordered_slice(df, ["k"], 250_000, 500_000), select.random_rows(df, "id", 700_000, 5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Exchange" not in plan.split("Union")[0]
    assert select.ordered_slice(df, ["k"], 250_000, 500_000).count() == 500_000
    some = select.random_rows(df, "id", 700_000, 5)
    assert some.count() == 700_000 == some.select("id").distinct().count()


def test_null_subset_takes_turns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "s string, k int").withColumn("h", F.md5(F.col("k").cast("string")))
    got = interleave.round_robin(df, "s", "h").orderBy("position").collect()
    assert [r.position for r in got] == list(range(6)) and [r.s for r in got] == [None, "a", "b"] * 2


def test_counts_come_from_footers(spark, tmp_path):
    for n in range(3):
        spark.range(10 * n + 1).withColumn("text", F.lit("x" * 100)).write.parquet(str(tmp_path / f"{n}"))
    files = [f"file://{f}" for f in sorted(tmp_path.rglob("*.parquet"))]
    counted = readers.footer_count(spark, files)
    assert counted.first()[0] == 33
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().toString()


def test_probe_reads_the_first_files_only(spark, tmp_path):
    files = {}
    for g in range(3):
        (tmp_path / str(g)).mkdir()
        for part in range(5):
            path = tmp_path / str(g) / f"{part}.parquet"
            pd.DataFrame({"text": ["w " * (i % 7) for i in range(300) if i % 3 == g and i % 5 == part]}).to_parquet(path, compression=None)
            if part:  # nothing beyond the footer of the others can be read
                raw = path.read_bytes()
                path.write_bytes(raw[:4] + b"\0" * 40 + raw[44:])
            files.setdefault((str(g),), []).append(f"file://{path}")
    tokens = F.size(F.split("text", " ")) - 1
    got = {r.g: r for r in budget.availability_of_files(spark, files, ["g"], tokens, tokens > 0).collect()}
    assert {g: r.n_rows for g, r in got.items()} == {"0": 100, "1": 100, "2": 100}
    for g in range(3):
        mine = [i % 7 for i in range(300) if i % 3 == g and i % 5 == 0 and i % 7]
        assert got[str(g)].avg_tokens == pytest.approx(sum(mine) / len(mine)) and got[str(g)].probed_rows == len(mine)
        assert got[str(g)].available == int(100 * sum(mine) / len(mine)) and got[str(g)].error > 0

"""Readers and writers, and the streaming gates over several triggers."""

import json

import pytest
from millrace.functions.keys import order_hash
from millrace.plans.mix import manifest
from millrace.sources import readers, writers
from millrace.streaming import ingest
from pyspark.sql import functions as F


def documents(spark, n=30):
    return spark.range(n).select(
        F.concat(F.lit("text "), "id").alias("text"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("source"),
        F.create_map(F.lit("lang"), F.lit("en")).alias("meta"),
        (F.col("id") % 7).alias("est_tokens"),
    )


def test_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_shards(documents(spark).coalesce(1), path, records=4)
    files = list((tmp_path / "out").rglob("*.json"))
    assert all(len(f.read_text().splitlines()) <= 4 for f in files) and len(files) == 8
    (tmp_path / "out" / "extra.jsonl").write_text('{"text":"x","source":"s9","est_tokens":1}\n\n\n')
    back = readers.read_shards(spark, path)
    assert back.count() == 31 and back.schema == readers.DOCUMENT_SCHEMA
    assert back.select(F.countDistinct(readers.shard_name())).first()[0] == 9
    (tmp_path / "out" / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.read_shards(spark, path).collect()


def test_pair_groups(spark, tmp_path):
    df = spark.createDataFrame([("s", "i")], "Source_Code string, IR_Original string").toPandas()
    for lang, name in (("C", "Perf_Optimized-0"), ("C", "Size_Optimized-0"), ("C++", "Perf_Optimized-1"), ("C", "other")):
        (tmp_path / lang).mkdir(exist_ok=True)
        df.to_parquet(tmp_path / lang / f"{name}.parquet")
    groups = readers.group_row_counts(readers.read_pair_groups(spark, str(tmp_path)))
    got = {(r[0], r[1]): r[2] for r in groups.collect()}
    assert got == {("C", "Perf_Optimized"): 1, ("C", "Size_Optimized"): 1, ("C++", "Perf_Optimized"): 1}


def test_splits_and_named(spark, tmp_path):
    root = tmp_path / "name" / "en"
    root.mkdir(parents=True)
    for split, n in (("train", 3), ("validation", 1)):
        spark.range(n).toPandas().to_parquet(root / f"{split}.parquet")
    got = readers.read_splits(spark, str(root)).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in got} == {"train": 3, "validation": 1}
    assert readers.read_named(spark, str(tmp_path), "name", "en", "train").count() == 3
    out = str(tmp_path / "blocks")
    writers.write_splits(spark.range(4).withColumn("split", F.lit("train")).withColumn("language", F.lit("C")), out)
    assert readers.read_supervised(spark, out, "C", "train").count() == 4
    assert readers.read_benchmark(spark, str(tmp_path), "missing") is None
    assert readers.read_benchmark(spark, str(tmp_path), "name", "en").count() == 4


def test_unified(spark, tmp_path):
    path = str(tmp_path / "u")
    writers.write_unified(spark.createDataFrame([("a", None)], "source_code string, est_tokens int"), path, records=10)
    assert spark.read.parquet(path).schema.names == readers.UNIFIED_SCHEMA.names
    assert tuple(spark.read.parquet(path).first()) == ("a", None, None, None, None, 0)


def test_generations(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([["a", "b"], ["c"], ["d"]]))
    got = readers.read_generations(spark, str(tmp_path / "g.json"), 2).collect()
    assert [tuple(r) for r in got] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    writers.write_candidates(spark.createDataFrame(got), str(tmp_path / "lines"))
    again = readers.read_candidate_lines(spark, str(tmp_path / "lines"))
    assert sorted(tuple(r) for r in again.collect()) == [("0", 0, "a"), ("0", 1, "b"), ("1", 0, "c")]


def test_id_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1\thello\n2\n3\tx\ty\n")
    p = readers.read_id_text(spark, str(tmp_path / "p.txt"))
    assert sorted(tuple(r) for r in p.collect()) == [("1", "hello"), ("2", ""), ("3", "x")]
    gold = spark.createDataFrame([("1", "g"), ("9", "g")], "id string, text string")
    assert [r["id"] for r in readers.matching_gold(gold, p).collect()] == ["1"]


def test_reports_and_results(spark, tmp_path):
    m = manifest(documents(spark), {"s0": 100, "s1": 50, "s2": 0}, seed=42)
    writers.write_manifest(m, str(tmp_path / "m"))
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row["seed"] == 42 and [s["source"] for s in row["sources"]] == ["s0", "s1"]
    assert row["tokens_written"] == sum(i % 7 for i in range(30))
    writers.write_metrics(spark.createDataFrame([(0.5,)], "pass_at_1 double"), {"seed": 1}, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).first()["config"]["seed"] == "1"
    runs = spark.createDataFrame([("t", 1, "b", 0, "OK"), ("t", 0, "a", 1, "Exception")], "task_id string, completion_id int, program string, exit_code int, status string")
    problems = spark.createDataFrame([("t", "p", ["z"])], "task_id string, prompt string, completions array<string>")
    writers.write_problem_results(problems, runs, str(tmp_path / "r"))
    r = spark.read.json(str(tmp_path / "r")).first()
    assert [x["program"] for x in r["results"]] == ["a", "b"] and "completions" not in r.asDict()
    writers.write_statuses(runs.withColumns({"language": F.lit("py"), "file": F.lit("f")}), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c")).count() == 2
    writers.write_predictions(spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1), "t", str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("part-*")).read_text()
    assert text.split(writers.PREDICTION_DELIMITER)[:2] == ["a", "b"]
    for _ in range(2):
        writers.write_results(spark.range(3), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 6


@pytest.mark.parametrize("kind", ["state", "batch"])
def test_stream_gate_over_triggers(spark, tmp_path, kind):
    schema = "key bigint, source string, est_tokens bigint"
    for i in range(4):
        part = spark.createDataFrame([(i * 10 + j, f"s{j % 2}", 5) for j in range(10)], schema)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = ingest.stream_shards(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, "parquet", 1)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    targets = {"s0": 52, "s1": 10**6}
    if kind == "state":
        setting = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(setting)
        with pytest.raises(ValueError, match=setting):
            ingest.stream_budget(stream, targets)
        spark.conf.set(setting, ingest.STATE_PROVIDER)
        kept = ingest.stream_budget(stream, targets)
        writer = kept.writeStream.format("parquet").option("path", out)
    else:
        keyed = stream.withColumn("order_key", order_hash("key", 1))
        # a table of budgets does as well as a mapping
        table = spark.createDataFrame(list(targets.items()), "source string, target bigint")
        writer = keyed.writeStream.foreachBatch(ingest.with_batch_budget(str(tmp_path / "totals"), out, table))
    writer.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    if kind == "state":
        spark.conf.set(setting, before)
    got = {r[0]: r[1] for r in spark.read.parquet(out).groupBy("source").agg(F.sum("est_tokens")).collect()}
    assert got == {"s0": 55, "s1": 100}

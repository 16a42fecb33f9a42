"""What grows with the input stays small: rows that leave a text, batches that Python holds, folders of shards."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import batches
from millrace.operators import pack, textscore
from millrace.sources import readers, writers


def generated_rows(spark, df):
    """Rows that leave all generators of a plan while it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def walk(node):
        own = node.metrics().apply("numOutputRows").value() if node.nodeName() == "Generate" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(plan)


def test_grams_are_clipped_inside_their_rows(spark):
    rows = [(i, " ".join(f"p{k}" for k in range(200)) + " same same", "same " + " ".join(f"e{k}" for k in range(200))) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, p string, e string")
    assert generated_rows(spark, textscore.pair_bleu(df, "id", "p", "e")) <= 10 * len(rows)
    by_id = textscore.sentence_bleu(df.select("id", F.col("p").alias("text")), df.select("id", F.col("e").alias("text")), "id")
    assert generated_rows(spark, by_id) <= 10 * len(rows)


def test_shared_grams_count_as_often_as_both_have_them(spark):
    rows = [("a b a b a", "a a b c"), ("a a a a", "a a a"), ("", "a"), ("a", "")]
    df = spark.createDataFrame(rows, "p string, e string").select(F.expr("filter(split(p, ' '), x -> x <> '') AS p"), F.expr("filter(split(e, ' '), x -> x <> '') AS e"))
    got = df.select(*[F.size(textscore._shared("p", "e", n)) for n in (1, 2)]).collect()
    assert [tuple(r) for r in got] == [(3, 1), (3, 2), (0, 0), (0, 0)]


def test_bleu_of_repeated_keys_and_references(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d f"), (1, "a b c d e", "a b c d f"), (2, "a b c d e", "a b c d f")], "id long, p string, e string")
    scores = {r.id: r.bleu for r in textscore.pair_bleu(df, "id", "p", "e").collect()}
    assert len(scores) == 2 and scores[1] > scores[2]
    refs = spark.createDataFrame([(2, "a b x y z"), (2, "v w c d e"), (2, "a b x y z"), (3, "a")], "id long, text string")
    (row,) = textscore.sentence_bleu(df.filter("id = 2").select("id", F.col("p").alias("text")), refs, "id").collect()
    # all five words, three of four pairs, one of three triples, none of two quadruples
    assert abs(row.bleu - (1 * (4 / 5) * (2 / 4) * (1 / 3)) ** 0.25) < 1e-9


def test_small_shards_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "RUN_RECORDS", 300)
    df = spark.range(2006).select(
        F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.create_map(F.lit("k"), F.lit("v")).alias("meta"), F.floor(F.col("id") / 2).alias("est_tokens"), "id",
    )
    writers.write_shards(df.repartition(5), str(tmp_path / "s"), 10, order="id")
    files = sorted((tmp_path / "s").rglob("*.json"))
    assert len(files) == 2 * 101 and len({f.parent for f in files}) == 2 * 4
    back = readers.read_shards(spark, str(tmp_path / "s")).withColumn("shard", writers.shard_number(readers.shard_name()))
    assert all(r.shard == r.est_tokens // 10 for r in back.collect())


def test_shards_of_repeated_and_null_keys(spark, tmp_path):
    keys = [None, *range(11), 5]  # the null takes a number and goes; both rows of 5 take both its places
    rows = [(f"t{i}", "a", {"k": "v"}, i, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "text string, source string, meta map<string,string>, est_tokens long, key long")
    writers.write_shards(df, str(tmp_path / "s"), 4, order="key")
    back = readers.read_shards(spark, str(tmp_path / "s")).groupBy(writers.shard_number(readers.shard_name()).alias("shard")).count()
    assert {r.shard: r["count"] for r in back.collect()} == {0: 3, 1: 6, 2: 4, 3: 1}


def test_blocks_are_cut_without_python_and_ids_move_once(spark, tmp_path):
    spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.col("id") * 3 % 50 + 1), lambda x: x.cast("int")).alias("input_ids")).write.parquet(str(tmp_path / "e"))
    blocks = pack.pack_blocks(spark.read.parquet(str(tmp_path / "e")), "id", 16, rows_per_bucket=10)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    # ids to their buckets, and the pieces at the borders; no move of all pieces between
    assert "hashpartitioning(_bucket" in plan and not re.search(r"hashpartitioning\(_bucket#\d+, _block", plan)


def test_batches_are_cut_by_bytes():
    texts = pa.array(["x" * 5, None, "é" * 10, "", "y" * 100, "z"])
    for whole in (texts, texts.slice(1, 5), texts.slice(0, 0)):
        cut = list(batches.slices([whole], 25))
        assert [v for c in cut for v in c.to_pylist()] == whole.to_pylist()
    assert [len(c) for c in batches.slices([texts], 25)] == [4, 1, 1]
    lists = pa.array([[["ab", "c"], []], None, [], [["d" * 40]], [[None, "e"]]])
    for whole in (lists, lists.slice(1), lists.slice(3, 1)):
        assert [v for c in batches.slices([whole], 30) for v in c.to_pylist()] == whole.to_pylist()
    assert len(list(batches.slices([lists], 30))) > 1
    ids = pa.array([[1] * 1000] * 50, pa.list_(pa.int32()))
    assert max(len(c) for c in batches.slices([ids], 1 << 15)) <= 4

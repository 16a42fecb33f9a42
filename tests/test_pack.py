"""Packing against a plain list, encoders, and instruction examples."""

import random

import pytest
from millrace.functions.encoders import code_points, vocabulary_file
from millrace.functions.keys import order_hash
from millrace.operators import instruct, pack
from millrace.plans.packing import tokenize_corpus


def documents(spark, n=120, seed=5):
    rng = random.Random(seed)
    data = [(i * 3, [rng.randrange(100) for _ in range(rng.choice([0, 1, 2, 7, 19, 64]))]) for i in range(n)]
    return data, spark.createDataFrame(data, "k bigint, input_ids array<int>").repartition(5)


def plain_blocks(sequences, size):
    flat = [x for s in sequences for x in s]
    return [flat[i : i + size] for i in range(0, len(flat) // size * size, size)]


@pytest.mark.parametrize("size", [1, 8, 16, 500])
@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_global_scope(spark, size, bucket_rows):
    data, df = documents(spark)
    got = pack.pack_blocks(df, "k", size, rows_per_bucket=bucket_rows).orderBy("block_id").collect()
    assert [r["block_id"] for r in got] == list(range(len(got)))
    assert [r["input_ids"] for r in got] == plain_blocks([s for _, s in data], size)


def test_hash_order(spark):
    data, df = documents(spark)
    keyed = df.withColumn("h", order_hash("k", 3)).drop("k")
    got = pack.pack_blocks(keyed, "h", 16, hashed=True).orderBy("block_id").collect()
    ordered = [r["input_ids"] for r in sorted(keyed.collect(), key=lambda r: r["h"])]
    assert [r["input_ids"] for r in got] == plain_blocks(ordered, 16)


def test_batch_scope_loses_each_tail(spark):
    data, df = documents(spark)
    got = pack.pack_blocks(df, "k", 16, "batch", batch_records=25, rows_per_bucket=9).orderBy("batch", "block_id").collect()
    want = [b for i in range(0, len(data), 25) for b in plain_blocks([s for _, s in data[i : i + 25]], 16)]
    assert [r["input_ids"] for r in got] == want


def test_vocabulary_encoder(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "tok.json")
    tok.save(path)
    enc = vocabulary_file(path, eos=9)
    df = spark.createDataFrame([("a b zz",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(enc.with_separator("t")).collect()] == [[0, 1, 2, 9], [9], [9]]


def test_missing_separator_is_an_error():
    with pytest.raises(ValueError):
        code_points(eos=None).with_separator("t")


def test_tokenize_corpus(spark):
    df = spark.createDataFrame(
        [(1, "abcdef", None, "pes2o"), (2, "", None, "pes2o"), (3, "x", "y", "paired_ir"), (4, "x", None, "paired_ir")],
        "k bigint, source_code string, llvm_ir string, source_dataset string",
    )
    out = tokenize_corpus(df, "k", code_points(), 7, validation=0.1)
    text = "abcdef\0" + "<source>\nx\n</source>\n<llvm_ir>\ny\n</llvm_ir>\0"
    rows = out.orderBy("block_id").collect()
    assert [r["input_ids"] for r in rows] == plain_blocks([[ord(c) for c in text]], 7)
    assert all(r["labels"] == r["input_ids"] and r["attention_mask"] == [1] * 7 for r in rows)
    assert sum(r["split"] == "validation" for r in rows) == 1
    with pytest.raises(ValueError):
        tokenize_corpus(df, "k", code_points(), 10_000)


def test_long_prompt_masks_everything(spark):
    df = spark.createDataFrame([(1, "q" * 50, "answer"), (2, "q", "ok")], "k bigint, ask string, answer string")
    rows = instruct.supervised_examples(df, "k", "ask", "answer", code_points(), 60, "$").orderBy("k").collect()
    assert set(rows[0]["labels"]) == {-100} and len(rows[0]["labels"]) == 60
    asked = len("### Instruction:\nq\n\n### Response:\n")
    assert rows[1]["labels"] == [-100] * asked + [ord(c) for c in "ok$"]


def test_padding(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1), [2] * (i + 1)) for i in range(5)], "k bigint, input_ids array<int>, labels array<int>")
    rows = instruct.padded_batches(df, "k", 2, pad=0).orderBy("k").collect()
    assert [len(r["input_ids"]) for r in rows] == [2, 2, 4, 4, 5]
    assert rows[0]["input_ids"] == [1, 0] and rows[0]["labels"] == [2, -100] and rows[0]["attention_mask"] == [1, 0]

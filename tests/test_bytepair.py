import json
import random

import pytest
import regex

from millrace.functions import bytepair
from millrace.plans.packing import vocabulary_path

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@pytest.fixture(scope="module")
def model():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return json.load(f)["model"]


@pytest.fixture(scope="module")
def by_hand(model):
    """One merge at a time, by token texts."""
    ranks = {tuple(m): n for n, m in enumerate(model["merges"])}
    symbols = bytepair.byte_symbols()
    known = {}

    def word(piece):
        if piece not in known:
            parts = [symbols[b] for b in piece.encode()]
            while True:
                ranked = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
                if not ranked:
                    break
                _, k = min(ranked)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known[piece] = [model["vocab"][p] for p in parts]
        return known[piece]

    return lambda text: [i for piece in PIECES.findall(text) for i in word(piece)]


@pytest.fixture(scope="module")
def encoder(spark):
    return bytepair.byte_pair_file(spark, f"file://{vocabulary_path()}", eos=50_256)


ODD = [
    "", " ", "\n\n  a", "a  b   c ", "it's 'll  don't", "Ünï Çödé ñandú", "日本語 テキスト", "12 345 x2y", "\t\ttabs\r\n", "🙂 emoji🙂🙂",
    "<|endoftext|>", "a\x00b\x01c", "  ", "x" * 3_000, "ab" * 500 + " " + "-" * 100, " line sep",
]


def test_odd_texts(spark, encoder, by_hand):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None)]
    got = {r.i: r.ids for r in spark.createDataFrame(rows, "i int, t string").select("i", encoder("t").alias("ids")).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(ODD)} | {99: []}


def test_all_texts(spark, encoder, by_hand):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", encoder("text").alias("ids"))
    rows = docs.collect()
    assert len(rows) == 1000 and all(r.ids == by_hand(r.text) for r in rows)


def test_long_and_short_merging_agree(model):
    rng = random.Random(1)
    symbols = bytepair.byte_symbols()
    vocab = model["vocab"]
    merges = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(model["merges"])}
    pairs = bytepair.BytePairs([vocab[s] for s in symbols], merges)
    for n in (1, 2, 3, 10, 40, 200):
        for letters in ("a", "ab", "the in", "aeiounrst "):
            ids = [pairs.bytes_[ord(rng.choice(letters))] for _ in range(n)]
            assert pairs._short(list(ids)) == pairs._long(list(ids))


def test_merges_as_text_and_missing_bytes(spark, tmp_path):
    symbols = bytepair.byte_symbols()
    vocab = {s: n for n, s in enumerate(symbols)} | {"ab": 256, "[[": 257}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b", "[ ["]}}))
    enc = bytepair.byte_pair_file(spark, f"file://{path}", eos=3)
    df = spark.createDataFrame([("ab[[",)], "t string")
    assert df.select(enc.with_separator("t")).first()[0] == [256, 257, 3]
    path.write_text(json.dumps({"model": {"vocab": {"a": 1}, "merges": []}}))
    with pytest.raises(ValueError):
        bytepair.byte_pair_file(spark, f"file://{path}", eos=3)


def test_separator(spark, encoder):
    assert spark.createDataFrame([("a",)], "t string").select(encoder.with_separator("t")).first()[0][-1] == 50_256

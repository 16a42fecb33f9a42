"""Signatures, buckets and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from millrace.operators import minhash, neardup
from millrace.operators.components import connected_components
from millrace.operators.reuse import evaluate_once
from millrace.plans.dedup import deduplicate
from pyspark.sql import functions as F


def test_band_plan():
    assert minhash.band_plan(0.7, 256) == (25, 10)
    assert minhash.band_plan(0.7, 128) == (14, 9)
    assert minhash.band_plan(0.7, 64) == (8, 8)
    assert minhash.band_plan(0.8, 256) == (17, 15)


def test_signature_equals_wide_integers():
    hashes = np.random.default_rng(1).integers(0, 1 << 32, 700, dtype=np.uint64)
    mult, add = minhash.permutations(16)
    want = [
        min(((int(h) * int(a) + int(b)) % (1 << 64) % minhash.PRIME) & minhash.HASH_MASK for h in hashes)
        for a, b in zip(mult, add)
    ]
    assert minhash.signature_of(hashes, 16).tolist() == want
    assert set(minhash.signature_of(hashes[:0], 16).tolist()) == {minhash.HASH_MASK}


def test_hashes_of_text():
    tokens = re.split("[^A-Za-z_0-9]", "a,b,,,c")
    assert tokens == ["a", "b", "", "", "c"]
    head = int.from_bytes(hashlib.sha1(b"a b   c").digest()[:4], "little")
    assert minhash.hashes_of("a,b,,,c", 5, 5).tolist() == [head]
    assert len(minhash.hashes_of("a b", 5, 5)) == 0


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_components(spark, hot_rows):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 5001 + i) for i in range(60)] + [(5030, 1020)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["id"]: r["cluster"] for r in connected_components(df, hot_rows=hot_rows).collect()}
    assert got == union_find(edges)


def corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(12)]
    texts = list(base)
    for i in range(40):
        words = base[i % 4].split()
        words[rng.randrange(120)] = "changed"
        texts.append(" ".join(words))
    texts += [base[5]] * 30 + ["too short", "a", ""]
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), texts


def brute_clusters(texts, num_perm=256):
    bands, rows = minhash.band_plan(0.7, num_perm)
    buckets = {}
    for i, t in enumerate(texts):
        sig = minhash.signature_of(minhash.hashes_of(t, 5, 5), num_perm)
        for b in range(bands):
            buckets.setdefault((b, sig[b * rows : (b + 1) * rows].tobytes()), []).append(i)
    return union_find([(m[0], x) for m in buckets.values() for x in m[1:]])


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_clusters_equal_brute_force(spark, hot_rows):
    df, texts = corpus(spark)
    got = {r["id"]: r["cluster"] for r in neardup.near_duplicate_clusters(df, "id", "text", hot_rows=hot_rows).collect()}
    assert got == brute_clusters(texts)


def test_survivors_share_no_band(spark):
    df, _ = corpus(spark)
    kept, report = deduplicate(df, "id", "text")
    texts = [r["text"] for r in kept.orderBy("id").collect()]
    assert brute_clusters(texts) == {}
    r = report.first()
    assert r["rows_before"] == df.count() and r["rows_after"] == len(texts)
    again = neardup.without_near_duplicates(df.repartition(7), "id", "text")
    assert sorted(x["id"] for x in again.collect()) == sorted(x["id"] for x in kept.collect())


def test_short_documents(spark):
    df, texts = corpus(spark)
    short = {i for i, t in enumerate(texts) if len(re.split("[^A-Za-z_0-9]", t)) < 5}
    kept = {m: {r["id"] for r in neardup.without_near_duplicates(df, "id", "text", short=m).collect()} for m in ("collapse", "keep", "drop")}
    assert kept["keep"] & short == short
    assert kept["drop"] & short == set()
    assert kept["collapse"] & short == {min(short)}


def test_sample_of_rows(spark):
    df, _ = corpus(spark)
    _, report = deduplicate(df, "id", "text", num_samples=10)
    assert report.first()["rows_before"] == 10


def test_repeated_work_runs_once(spark):
    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "id bigint, program string")
    seen = []

    def evaluate(programs):
        seen.append(programs.count())
        return programs.withColumn("status", F.upper("program"))

    out = evaluate_once(df, "program", evaluate, hot_rows=4).collect()
    assert seen == [3] and len(out) == 30 and all(r["status"] == r["program"].upper() for r in out)

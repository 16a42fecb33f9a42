import hashlib
import zlib

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from millrace.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root of a list of nodes, and for each the (left, right) siblings on the way up."""
    paths, above = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(paths, above):
            run = at // 3 * 3
            p.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        above = [at // 3 for at in above]
    return nodes[0] if nodes else None, paths


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) for rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2])) for g in names}
    low = {g: tree([x[2] for x in own[g]]) for g in names}
    root, high = tree([low[g][0] for g in names])
    out = []
    for g, upper in zip(names, high):
        for (_, k, own_leaf, r), path in zip(own[g], low[g][1]):
            node, steps = own_leaf, path + upper
            if k is not None and zlib.crc32(str(k).encode()) % 2 == 0 and r[4] is not None:
                node = leaf(*r[:4], r[4].replace("\n", ""))
            for left, right in steps:
                node = sha(left, node, right)
            out.append((k, own_leaf, low[g][0], root, sha(*(a + b for a, b in steps)), node))
    return out


def found(df, levels=merkle.LEVELS):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows, root = merkle.manifest(df, levels=levels, given=merkle.leaf("doc_id", "source", "lang", "n_chars", text))
    named = rows.select("key", "leaf", "subroot", F.lit(root).alias("root"), F.sha2(merkle.siblings("path"), 256).alias("proof"), merkle.folded("given", "path").alias("to"))
    return sorted(map(tuple, named.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_every_shape_of_tree(spark, levels):
    sizes = [1, 2, 3, 4, 5, 9, 10, 27, 28, 60]
    rows = [(100 * g + i, f"s{g}", "en", i, f"line\n{i}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(df, levels) == sorted(by_hand(rows), key=str)


def test_odd_rows(docs, odd):
    df = docs([*odd, *odd[:3], *[(i, f"a\nb{i}") for i in range(-5, 0)], (11, "é\n" * 50_000)])
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert found(df, 1) == sorted(by_hand(rows), key=str)
    assert any(r.source is None for r in df.collect())


def test_all_rows_alike(docs):
    df = docs([(7, "a\nb")] * 40 + [(None, None)] * 20)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert found(df, 2) == sorted(by_hand(rows), key=str)


def test_rows_of_many_buckets(docs, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(merkle, "HOT_ROWS", 10)
    df = docs([(i * 37 % 200 - 50, f"x\n{i}") for i in range(200)])
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert found(df, 2) == sorted(by_hand(rows), key=str)


def test_no_rows(docs):
    rows, root = merkle.manifest(docs([]))
    assert root is None and rows.collect() == []


def test_query_on_tables(spark, sf_dir):
    assert difference(merkle.op13_merkle_manifest(spark, sf_dir), connect(sf_dir), merkle.SQL) is None


def test_only_changed_texts_fail(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in merkle.op13_merkle_manifest(spark, sf_dir).collect():
        assert r.verified == ("\n" not in texts[r.doc_id] or zlib.crc32(str(r.doc_id).encode()) % 2 == 1)

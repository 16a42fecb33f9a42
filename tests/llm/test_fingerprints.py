import hashlib
import re
from collections import Counter

import xxhash

from millrace.llm import fingerprints as fp

LOW = (1 << 64) - 1
ODD = [int(c) for c in fp.ODD]


def mixed(v):
    v = (v ^ v >> 32) * ODD[0] & LOW
    v = (v ^ v >> 32) * ODD[1] & LOW
    return v ^ v >> 32


def by_hand(text, count=fp.SKETCHES):
    """Every function over every numbered k-mer, one by one."""
    words = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")]
    kmers = [mixed((w * ODD[2] + mixed(then)) & LOW) for w, then in zip(words, [*words[1:], 0])]
    seen, marks = Counter(), []
    for k in kmers:
        marks.append(mixed((k + seen[k] * ODD[2]) & LOW))
        seen[k] += 1
    out = b""
    for j in range(1, count + 1):
        seed = mixed(j * ODD[2] & LOW)
        low = sorted(range(len(marks)), key=lambda i: mixed(marks[i] ^ seed))[: fp.TUPLE]
        h = seed
        for i in sorted(low):
            h = mixed((h * ODD[0] + kmers[i]) & LOW)
        out += (h >> 32).to_bytes(4, "big")
    return out


def test_sketches_against_brute_force(docs, odd, prose):
    rows = odd + [(30, "a a a a a a"), (31, "b a b a b a b"), (32, prose(300, 4) + " " + prose(300, 4))]
    got = fp.sketches(docs(rows).select("text"), "text", "s").collect()
    assert len(got) == len(rows)
    for r in got:
        if len(r.text or "") < 10_000:
            assert bytes(r.s) == by_hand(r.text)


def test_blocks_do_not_matter(prose):
    for text in (prose(900, 1), "a " * 700, "a", "", "b a b a b a b"):
        whole = fp.Sketcher().sketch(text)
        assert whole == by_hand(text)
        assert all(fp.Sketcher(block=size).sketch(text) == whole for size in (1, 2, 7, 64))


def test_neighbours_cross_range_borders(docs, prose):
    rows = [(i, f"{i} {prose(5, i)}") for i in range(60)] + [(None, "last")]
    for size in (4096, 7, 1):
        got = {r.doc_id: r.next.text for r in fp.beside_next(docs(rows).select("doc_id", "text"), "doc_id", "text", rows_per_bucket=size).collect()}
        order = sorted(range(60), reverse=True) + [None]
        texts = dict(rows)
        assert got == {k: texts[order[(n + 1) % len(order)]] for n, k in enumerate(order)}


def agreeing(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / fp.SKETCHES


def test_query_on_tables(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in fp.op9_order_minhash(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for n, k in enumerate(order):
        text, after = texts[k], texts[order[(n + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if n < 25:
            own, new, other = by_hand(text), by_hand(edited), by_hand(after)
            assert r.fingerprint == own.hex() and r.edited_fingerprint == new.hex()
            assert r.near_edited == agreeing(own, new) and r.near_next == agreeing(own, other)


def test_order_matters(prose):
    a = prose(400, 1).split()
    of = fp.Sketcher(count=256).sketch
    own, moved, sorted_words = of(" ".join(a)), of(" ".join(a[200:] + a[:200])), of(" ".join(sorted(a)))

    def near(x):
        return sum(own[i : i + 4] == x[i : i + 4] for i in range(0, len(own), 4)) / 256

    assert near(own) == 1 and near(sorted_words) < near(moved) < 0.8


def test_one_document_and_none(docs):
    assert fp.beside_next(docs([(1, "a")]).select("doc_id", "text"), "doc_id", "text").first().next.text == "a"
    assert fp.beside_next(docs([]).select("doc_id", "text"), "doc_id", "text").collect() == []

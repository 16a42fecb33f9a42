import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.session import materialize


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def check(pieces, want, window=packing.WINDOW):
    """All ids of ``want`` (row -> ids) lie in exactly one piece; sequences have no gap; returns the padding."""
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p.row].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.n == len(want[p.row]) and bytes(p.part) == want[p.row][p.start : p.start + p.length].tobytes()
    assert set(by_row) == set(want)
    for row, ps in by_row.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(want[row])
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at.bit_count() == 1 else window - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding


def same_digests(ids, window=packing.WINDOW):
    """Digests that were known when encoding equal those of the pieces."""
    parts = sorted((p.key or 0, p.n, p.start, p.length, p.sequence_id, p.offset, zlib.crc32(bytes(p.part))) for p in packing.pack(ids, window).collect())
    return parts == sorted((p.key or 0, p.n, p.start, p.length, p.sequence_id, p.offset, p.crc32) for p in packing.piece_digests(ids, window).collect())


def rows_of(ids):
    return {r.row: np.frombuffer(bytes(r.ids), "<u4") for r in ids.collect()}


@pytest.mark.parametrize("part, remembered", [(1 << 20, 1 << 24), (50, 10)])
def test_ids_are_those_of_the_whole_text(docs, odd, tokenizer, monkeypatch, part, remembered):
    encoder = packing.Encoder(packing.vocabulary_path())
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    tokenizer.encode_special_tokens = True
    monkeypatch.setattr(packing.parts, "__defaults__", (part,))
    rows = [*odd, (24, "a\x1cb!\x1c ?\x85x\u2028\u3000 y  z\t\n é\n\n \n!"), (27, "word's it'll x' 's don't! été, ²x ªº «quote» _a_ a_b"), (25, " lead"), (26, "trail \n "), (20, "a b " * 100_000), (21, "x" * 200_000), (22, "say <|endoftext|> here"), (23, "é 'd it's  \n\n  don 't 1 2 a b " * 5_000)]
    got = packing.encoded(docs(rows), "doc_id", "text").collect()
    tokenizer.encode_special_tokens = True
    for _, t in rows:
        assert np.frombuffer(encoder.ids(t or ""), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    want = sorted((str(k), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows)
    assert sorted((str(r.key), np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == want


@pytest.mark.parametrize("window", [8, 64, 2048])
def test_every_id_once(docs, odd, prose, window):
    df = docs([*odd, *[(100 + i, prose(i % 90, i)) for i in range(300)]])
    ids = materialize(packing.encoded(df, "doc_id", "text", window=window))
    pieces = packing.pack(ids, window).collect()
    assert check(pieces, rows_of(ids), window) == 0
    assert same_digests(ids, window)


def test_hot_length_and_buckets(docs, prose, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 16)
    ids = materialize(packing.encoded(docs([(7, prose(50, 1))] * 200 + [(i, prose(i, i)) for i in range(100)]), "doc_id", "text"))
    assert check(packing.pack(ids, 256).collect(), rows_of(ids), 256) == 0


def test_no_rows_and_no_text(docs):
    ids = materialize(packing.encoded(docs([]), "doc_id", "text"))
    assert packing.pack(ids).collect() == []
    ids = materialize(packing.encoded(docs([(None, None), (1, "")]), "doc_id", "text"))
    assert sorted((p.key or 0, p.start, p.length, p.n) for p in packing.pack(ids).collect()) == [(0, 0, 1, 1), (1, 0, 1, 1)]


def test_counts_solve_the_least_squares():
    rng = np.random.default_rng(1)
    counts = np.zeros(32, np.int64)
    counts[1:] = rng.integers(0, 60, 31)
    combos = packing.combinations(counts, 32)
    assert all(sum(c) == 32 and 2 <= len(c) <= 3 for c in combos) and len(set(combos)) == len(combos)
    x = packing.repeat_counts(counts, combos, 20_000)
    a = np.zeros((32, len(combos)))
    for i, c in enumerate(combos):
        for v in c:
            a[v, i] += 1
    w = 1 / np.sqrt(np.maximum(counts, 1))[:, None]
    gradient = (w * a).T @ ((w * a) @ x - w[:, 0] * counts)
    # the conditions of the least distance: no descent for a positive count, none into a count of zero
    assert (x >= 0).all() and np.abs(gradient[x > 1e-3]).max() < 0.05 and gradient.min() > -0.05
    used = np.zeros(32, np.int64)
    for n, c in packing.rounded(x, combos, counts):
        for v in c:
            used[v] += n
    assert (used <= counts).all() and used @ np.arange(32) >= 0.8 * (counts @ np.arange(32))


def test_most_remainders_stay_whole():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 2048, 200_000), minlength=2048)
    plan = packing.layout([(i, int(n), 0) for i, n in enumerate(counts) if n])
    whole = sum(n for _, _, n, _, _ in plan.slots)
    assert whole > 0.9 * counts.sum()


def test_sequences_hold_the_ids(docs, prose):
    ids = materialize(packing.encoded(docs([(i, prose(i, i)) for i in range(60)]), "doc_id", "text"))
    pieces = materialize(packing.pack(ids, 64))
    built = packing.sequences(pieces, 64).collect()
    assert sum(len(r.ids) for r in built) == sum(v.nbytes for v in rows_of(ids).values())
    assert all(r.padding == 0 for r in built) and sum(len(r.ids) == 256 for r in built) >= len(built) - 6


def test_query_on_tables(spark, sf_dir, tokenizer):
    tokenizer.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    sizes = defaultdict(int)
    seen = defaultdict(int)
    for r in packing.op12_packing(spark, sf_dir).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        sizes[r.sequence_id] += r.length
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    assert all(n == 2048 or n.bit_count() == 1 for n in sizes.values())

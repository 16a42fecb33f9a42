import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash


def by_hand(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, bits=4):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ids):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprints(odd, prose):
    for _, text in odd + [(0, "A b"), (0, "a B c D e"), (0, "é\x0ba b c d"), (0, prose(70_000, 1))]:
        assert simhash.fingerprint(text) == by_hand(text)


def test_components_against_brute_force(docs, odd, prose):
    rows = odd + [(20 + i, prose(200, i % 5) + " tail" * (i % 3)) for i in range(15)]
    found = simhash.near_duplicates(docs(rows)).collect()
    assert len(found) == len(rows)
    ids, fps = [r.id for r in found], [r.fp & (1 << 64) - 1 for r in found]
    assert sorted(map(str, fps)) == sorted(str(by_hand(t)) for _, t in rows)
    assert [r.component for r in found] == components(ids, fps)


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_join_finds_every_link(spark, shard_rows):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    family = [int(centres[0])]
    for _ in range(150):  # a chain of near copies, each of another one
        x = family[rng.integers(0, len(family))]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        family.append(x)
    near = [int(c) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for c in centres[1:80]]
    fps = sorted({*map(int, centres), *family, *near})
    points = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    links = simhash.fingerprint_links(points, len(fps), leaf_rows=8, shard_rows=shard_rows).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1
        assert bin(a ^ b).count("1") <= 4
        root[find(a)] = find(b)
    want = components(fps, fps)
    groups, have = {}, {}
    for x, c in zip(fps, want):
        groups.setdefault(c, set()).add(x)
        have.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, have.values()))


def test_trees_route_every_near_pair_together():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 24, 500, dtype=np.uint64)
    tree = simhash.Tree(values, 5, 1)
    near = values ^ np.uint64(1 << 7)
    home = {int(r): int(leaf) for r, leaf, h in zip(*tree.route(values)) if h}
    visits = {}
    for r, leaf, _ in zip(*tree.route(near)):
        visits.setdefault(int(r), set()).add(int(leaf))
    assert len(home) == 500 and all(home[i] in visits[i] for i in home)


def test_segments_must_cover():
    with pytest.raises(ValueError):
        simhash.check_segments(((0, 32, 1), (32, 32, 1)), 4)


def test_one_of_each_group_stays(docs, odd):
    kept = simhash.without_near_duplicates(docs(odd)).collect()
    ids = [r.doc_id for r in kept]
    # 10 is the text of 1 twice, which hardly changes the majority of any bit
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9] and ids.count(None) == 2
    assert simhash.without_near_duplicates(docs([])).collect() == []
    assert simhash.near_duplicates(docs([])).collect() == []


def test_null_keys_go_where_the_group_has_a_key(docs, prose):
    df = docs([(None, prose(30, 1)), (5, prose(30, 1)), (5, prose(30, 1)), (None, prose(30, 2))])
    assert [(r.doc_id, r.text) for r in simhash.without_near_duplicates(df).orderBy("doc_id").collect()] == [(None, prose(30, 2)), (5, prose(30, 1))]

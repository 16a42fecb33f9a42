from collections import defaultdict

from millrace.llm import mixing


def level_by_hand(sizes, weights, budget):
    """Shares by weight, the excess of full sources dealt again until none is above."""
    full, rest = {}, set(sizes)
    while rest:
        left, weight = budget - sum(full.values()), sum(weights[s] for s in rest)
        above = {s for s in rest if left * weights[s] / weight > 2 * sizes[s]}
        if not above:
            return full | {s: left * weights[s] / weight for s in rest}
        full |= {s: 2 * sizes[s] for s in above}
        rest -= above
    return full


def seats_by_hand(targets, blocks, seats):
    got = dict.fromkeys(targets, 0)
    for _ in range(seats):
        open_ = [s for s in targets if got[s] < 2 * blocks[s] and targets[s] > 0]
        if not open_:
            break
        got[max(open_, key=lambda s: targets[s] / (2 * got[s] + 1))] += 1
    return got


def test_targets_quotas_and_takes(spark, docs, prose):
    sizes = [900, 40, 700, 33, 12, 5, 410, 380, 77, 60, 1]
    df = docs([(i, prose(n, i)) for i, n in enumerate(sizes)])
    rows = mixing.mix(df).collect()
    held, took, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert sum(r.shard_tokens) <= 2 * r.size and min(r.shard_tokens) >= 0
        held[r.source] += r.size
        took[r.source] += sum(r.shard_tokens)
        target[r.source] = r.target
    order = sorted((s for s in held if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = level_by_hand(held, weights, 1.5 * sum(held.values()))
    for s in held:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(took[s] - want[s]) <= 0.02 * want[s] + 4


def test_quotas_are_those_of_the_one_by_one_rule(spark):
    rows = [("a", "sa", 5000), ("b", "sb", 900), ("c", "sc", 300), ("d", "sd", 0)]
    sizes = spark.createDataFrame(rows, "source string, source_key string, size long")
    quotas = mixing.block_quotas(mixing.source_targets(sizes), shards=4, smallest_blocks=30).collect()
    block = quotas[0].block
    targets = {r.source: r.target for r in quotas}
    blocks = {r.source: r.blocks for r in quotas}
    seats = int(1.5 * 6200 / block + 0.5)
    for shard in range(1, 5):
        want = seats_by_hand(targets, blocks, int(seats * shard / 4 + 0.5))
        assert {r.source: r.ends[shard - 1] for r in quotas} == want


def test_odd_rows(docs, odd):
    rows = mixing.mix(docs(odd)).collect()
    assert len(rows) == len(odd)
    assert all(sum(r.shard_tokens) == 0 for r in rows if r.size == 0)
    again = mixing.mix(docs(odd)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty_tables(docs):
    assert mixing.mix(docs([])).collect() == []
    assert [r.size for r in mixing.mix(docs([(1, None), (2, "")])).collect()] == [0, 0]
    assert mixing.mixed_documents(docs([])).collect() == []


def test_mixed_documents_keep_their_columns(docs, odd):
    given = docs(odd)
    found = mixing.mixed_documents(given)
    assert found.columns == [*[c for c in given.columns if c != "size"], "size", "source_size", "target", "shard_tokens", "taken"]
    assert found.count() == len(odd)

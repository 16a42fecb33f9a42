import re

from millrace.llm import decontaminate as d


def words(text):
    lowered = (text or "").translate(str.maketrans(d.UPPER, d.UPPER.lower()))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(texts, items):
    windows = set()
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        windows |= {(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size and item is not None}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_against_brute_force(spark, docs, odd, prose):
    long = prose(30, 77)
    items = [("a", long), ("b", prose(14, 5)), ("c", "Only, THREE words"), ("d", ""), ("e", None), ("f", long), ("10", "xx"), (None, "zzz")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = odd + [(20, f"so {long} end"), (21, long.upper() + "!"), (22, f"only-three words xx only three, words {prose(14, 5)}"), (23, "three words"),
                  (24, " ".join(long.split()[5:17])), (25, " ".join(long.split()[:9])), (None, long)]
    df = docs(rows)
    for bound in (d.BROADCAST_ROWS, 5):
        counted, found = d.contamination(df, bench, rows=bound)
        got = {(r.doc, r.digest): r.n_hit for r in d.covered(found).collect()}
        named = {}
        for r in d.items_hit(found, bench).collect():
            named.setdefault((r.doc, r.digest), []).append(r.item)
        keys = [(r.doc, r.digest, r.n_words) for r in counted.collect()]
        assert len(keys) == len(rows)
        want = by_hand([t for _, t in rows], items)
        have = sorted((k, n, got.get((k, g), 0), sorted(named.get((k, g), []))) for k, g, n in keys if k is not None)
        assert have == sorted((k, *w) for (k, _), w in zip(rows, want) if k is not None)
        assert got[next((k, g) for k, g, n in keys if k is None and n == 30)] == 30


def test_clean_and_spans(spark, docs, prose):
    bench = spark.createDataFrame([("a", prose(12, 1))], "item_id string, text string")
    df = docs([(1, f"start {prose(12, 1)} end"), (2, prose(50, 2)), (3, None), (None, prose(12, 1))])
    assert sorted(r.doc_id for r in d.clean(df, bench).collect()) == [2, 3]
    assert d.clean(df, bench).columns == df.columns
    spans = {r.doc_id: r.text for r in d.without_spans(df, bench).collect()}
    assert spans == {1: "start end", 2: prose(50, 2), 3: None, None: ""}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert d.clean(docs([(1, "a b")]), none).count() == 1
    assert d.contamination(docs([]), none)[1].count() == 0

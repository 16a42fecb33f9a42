import random

from pyspark.sql import functions as F

from millrace.llm import linededup as ld
from millrace.session import materialize


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, least=ld.MIN_CHARS):
    """Lines in document order; one goes if any earlier one is within one edit."""
    first = dict.fromkeys(rows)
    seen, removed = [], {}
    for key, text in sorted(first, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" \t\r")
            if len(line) >= least:
                if any(within_one(line, s) for s in seen):
                    removed.setdefault((key, text), []).append(n)
                seen.append(line)
    return removed


def edited(line, rng):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + "#" + line[i:], line[:i] + "%" + line[i + 1 :]])


def corpus(prose):
    rng = random.Random(8)
    pool = [prose(6, i) for i in range(40)] + ["aaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaa", "ÉÉ ñandú más allá del río", "short"]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edited(line, rng)
            lines.append(rng.choice(["", "  ", "\t"]) + line + rng.choice(["", "\r", " "]))
        rows.append((k, "\n".join(lines)))
    return rows


def test_against_brute_force(docs, odd, prose):
    rows = corpus(prose) + [(100 + (k or 0), t) for k, t in odd if k is not None]
    want = by_hand(rows)
    got = ld.removed_lines(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t)
    for r in got:
        assert list(r.removed) == want.get((r.doc_id, texts[r.doc_id][0]), []), r
    assert sum(map(len, want.values())) > 100


def test_texts_are_cut(docs, prose):
    a, b = prose(8, 1), prose(8, 2)
    rows = [(1, f"{a}\nshort\n\n{b}"), (2, f"x\n {a}\nshort\n{b}!\ny"), (3, a), (4, None), (5, ""), (None, b), (6, a), (6, a)]
    df = docs(rows)
    out = ld.dedup_lines(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert got == [(1, rows[0][1]), (2, "x\nshort\ny"), (3, ""), (4, None), (5, ""), (6, ""), (6, ""), (None, "")]


def test_same_key_with_other_texts(docs, prose):
    rows = [(1, prose(8, 1)), (1, prose(8, 2)), (2, prose(8, 2))]
    assert sorted((r.doc_id, list(r.removed)) for r in ld.removed_lines(docs(rows)).collect()) == [(1, []), (1, []), (2, [0])]


def test_long_lines_and_empty_table(docs):
    line = "z" * 40_000
    assert [list(r.removed) for r in ld.removed_lines(docs([(1, line), (2, line[:-1])])).orderBy("doc_id").collect()] == [[], [0]]
    assert ld.removed_lines(docs([])).collect() == []


def test_more_texts_than_the_broadcast_bound(docs, prose, monkeypatch):
    monkeypatch.setattr(ld.line_texts, "__defaults__", (3,))
    rows = corpus(prose)
    want = by_hand(rows)
    assert {r.doc_id: list(r.removed) for r in ld.removed_lines(docs(rows)).collect()} == {k: want.get((k, t), []) for k, t in rows}


def broadcasts(df):
    """The broadcasts that a run of ``df`` really made; its plan is settled by then."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("BroadcastExchange")


def test_what_grows_from_few_bytes_is_not_broadcast(spark, docs, prose):
    # by the planner's sizes all of these look far below its broadcast threshold, however many variants a line has
    given = materialize(ld._documents(docs(corpus(prose)), "doc_id", "text"))
    firsts = materialize(ld.first_places(ld.eligible_lines(given)))
    found = ld.candidates(firsts)
    assert broadcasts(found) == 0
    found = materialize(found)
    assert broadcasts(ld.line_texts(given, found)) == 1
    assert broadcasts(ld.line_texts(given, found, 3)) == 0
    texts = materialize(ld.line_texts(given, found))
    variants = ld.variants(texts)
    assert variants.count() > 20 * texts.count()
    pairs = ld.partners(variants)
    assert broadcasts(pairs) == 0
    assert broadcasts(ld.verified(pairs, texts)) == 0

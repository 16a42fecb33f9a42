import random
import re
import zlib
from collections import Counter

import pytest
from compare import connect, difference

from millrace.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def words_by_hand(rows, min_length=5, min_count=3):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_length and n >= min_count}


def by_hand(words):
    forms, out = {}, []
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(close[w]), words.get(forms[w])))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_vocabulary(docs, odd, prose):
    rows = [*odd, (20, "ÉCOLE École école ÉCOLE éCOLE éCOLE éCOLE ×÷×÷× " * 3), *[(i, prose(60, i)) for i in range(50, 90)]]
    found = {r.word: r.n for r in spelling.vocabulary(docs(rows)).collect()}
    assert found == words_by_hand(rows) and "école" in found and "École" in found


@pytest.mark.parametrize("group_words", [20_000, 40, 2])
def test_near_words_against_brute_force(spark, group_words):
    rng = random.Random(group_words)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): rng.randint(3, 60) for _ in range(400)}
    words |= {"aaaaa": 5, "aaaaaa": 9, "aaaaaaa": 90, "baaaaa": 4, "z" * 3_000: 3, "z" * 3_001: 7, "y" + "z" * 2_999: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    found = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, group_words=group_words).collect()}
    want = {}
    for w in words:
        close = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        if close:
            best = min(close, key=lambda v: (-words[v], v))
            want[w] = (len(close), words[best], best)
    assert found == want


def test_acceptors_are_minimal():
    machine = spelling.Acceptors()
    words = sorted({a + b + c for a in "abcd" for b in "xy" for c in ("st", "t", "")})
    root = machine.add(words)
    # after the first letter all words go on alike: root, letter, pair, s, t's end
    assert len(machine.arcs) == 5 and machine.words[root] == len(words)
    assert machine.add(words) == root


def test_groups(docs, odd):
    rows = [*odd, (50, "colour " * 40 + "colours " * 12 + "coloours " * 5 + "cooloours " * 3 + "colonr " * 15 + "collour " * 20)]
    rows += [(60 + i, "stone stones stoned") for i in range(4)]
    assert got(spelling.variant_groups(docs(rows))) == by_hand(words_by_hand(rows))


def test_no_words(docs):
    for rows in ([], [(1, None), (2, "a b c 1 2"), (None, "")]):
        assert spelling.variant_groups(docs(rows)).collect() == []


def test_query_on_tables(spark, sf_dir):
    found = spelling.op11_spelling_variants(spark, sf_dir)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(found) == by_hand(words_by_hand(texts))
    assert difference(found, connect(sf_dir), spelling.SQL) is None

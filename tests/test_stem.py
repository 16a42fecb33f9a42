import random
import re

import pytest
from compare import connect

from millrace.functions import stem
from millrace.operators import textscore

# Examples of the published description and of its extensions.
KNOWN = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre disabled disabl matting mat mating mate meeting meet
milling mill messing mess meetings meet plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky enjoy enjoy relational relat
conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control
roll roll generalizations gener oscillators oscil dies die died die spied spi skies sky dying die news news innings inning
succeed succeed analogi analog geologi geolog by by say say cry cri try tri eye eye""".split()


def vowel(w, i):
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))


def measure(w):
    return len(re.findall("v+c+", "".join("v" if vowel(w, i) else "c" for i in range(len(w)))))


def short(w):
    if len(w) == 2:
        return vowel(w, 0) and not vowel(w, 1)
    return len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"


def by_hand(w):
    """The rules word by word."""
    if len(w) <= 2 or w in stem.LISTED:
        return stem.LISTED.get(w, w)

    def first(w, rules):
        for suffix, new, holds in rules:
            if w.endswith(suffix):
                before = w[: len(w) - len(suffix)]
                return before + new if holds(before) else w
        return w

    w = w[:-1] if w.endswith("ies") and len(w) == 4 else first(w, [(a, b, lambda x: True) for a, b in stem.PLURALS])
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            before = w[: -len(suffix)]
            if w.endswith(suffix) and any(vowel(before, i) for i in range(len(before))):
                w = before
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1):
                    w = w if w[-1] in "lsz" else w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and len(w) > 2 and not vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    if w.endswith("alli") and measure(w[:-4]):
        w = w[:-2]
    some = lambda x: measure(x) > 0
    if w.endswith("logi") and measure(w[:-3]):
        w = w[:-1]
    else:
        w = first(w, [(a, b, some) for a, b in stem.DERIVED])
    w = first(w, [(a, b, some) for a, b in stem.ENDINGS])
    w = first(w, [(a, "", lambda x, a=a: measure(x) > 1 and (a != "ion" or x[-1] in "st")) for a in stem.DROPPED])
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def sample():
    rng = random.Random(3)
    ends = [a for a, _ in [*stem.PLURALS, *stem.DERIVED, *stem.ENDINGS]] + stem.DROPPED + ["ed", "ing", "eed", "ied", "ies", "y", "e", "ll", "logi"]
    heads = ["".join(rng.choice("aeiouybcdlstrwxz") for _ in range(rng.randint(1, 7))) for _ in range(250)]
    words = {h + e + rng.choice(["", "", "s", "ly", "ed"]) for h in heads for e in rng.sample(ends, 8)}
    return sorted(words | set(KNOWN) | {"yy", "syyyyed", "yyyed", "ayyying", "x1y2s", "sayyids", "1990s"})


def test_published_pairs(spark):
    pairs = list(zip(KNOWN[::2], KNOWN[1::2]))
    assert [by_hand(a) for a, _ in pairs] == [b for _, b in pairs]
    got = spark.createDataFrame(pairs, "w string, s string").selectExpr("w", "array(w) AS a").select("w", stem.stems("a", 0).alias("g"))
    assert [(r.w, r.g[0]) for r in got.collect()] == pairs


def test_rules_and_their_sql_against_plain_steps():
    words = sample()
    got = {w: stem.stem(w) for w in words}
    assert got == {w: by_hand(w) for w in words}
    con = connect("/root/testdata/sf0.001")
    con.execute("CREATE TABLE given AS SELECT unnest(?) AS word", [words])
    assert dict(con.sql(f"WITH {stem.sql_stems('given')} SELECT word, stem FROM stemmed").fetchall()) == got


def test_short_words_stay_in_lists(spark):
    df = spark.createDataFrame([(["was", "cats", "running", "the"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(stem.stems("w")).collect()] == [["was", "cat", "run", "the"], [], []]


def test_scores_on_stems(spark):
    df = spark.createDataFrame([(1, "the runners were running", "a runner runs")], "id int, p string, e string")
    assert textscore.rouge_n(df, "id", "p", "e", 1).first()[1] == 0
    assert textscore.rouge_n(df, "id", "p", "e", 1, stemmed=True).first()[1] == pytest.approx(2 * 2 / 7)
    assert textscore.rouge_l(df, "id", "p", "e", stemmed=True).first()[1] == pytest.approx(2 * 2 / 7)
    assert textscore.rouge(df, "id", "p", "e").first()["rougeLsum"] == pytest.approx(100 * 2 * 2 / 7)


def plain_places(a, b):
    """All rows of the dynamic programme, and the way back."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    i, j, used = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            used.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return used


def test_way_back_is_that_of_the_full_table():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(40))]
        assert textscore._subsequence_places(a, b) == plain_places(a, b)


def test_long_lines_take_little_memory():
    import tracemalloc

    rng = random.Random(6)
    a, b = ([str(rng.randrange(500)) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    found = textscore._subsequence_places(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == textscore._lcs_length(a, b) and peak < 50e6

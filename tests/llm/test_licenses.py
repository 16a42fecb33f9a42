import re
from collections import Counter

from millrace.llm import licenses as lic

KNOWN = lic.Templates(lic.TEMPLATES)


def dice(a, b):
    def pairs(text):
        w = re.findall(r"[a-z0-9]+", re.sub(r"(?im)^\W*(copyright\b|©|\(c\)).*$", "", text.lower()))
        return Counter(zip(w, w[1:]))

    x, y = pairs(a), pairs(b)
    return 2 * (x & y).total() / (x.total() + y.total()) if x.total() else 0.0


def by_hand(text):
    """Every part against every template, without bounds or index."""
    best = {}
    pieces = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    for name, templates in lic.TEMPLATES.items():
        score = max(dice(p, t) for p in pieces for t in templates)
        if score >= lic.THRESHOLD:
            best[name] = score
    return best


def test_against_brute_force(spark, sf_dir, prose):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:120]
    mit, apache = lic.TEMPLATES["MIT"][2], lic.TEMPLATES["Apache-2.0"][1]
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    texts += [mit, "Copyright 2020 Me\n" + mit, wrapped, f"{prose(50, 1)}\n\n{apache}\n\n{prose(50, 2)}", mit.replace("Software", "Program")]
    for text in texts:
        got = {name: d for name, d, _, _ in lic.scan(text, KNOWN)}
        want = by_hand(text)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), text[:80]


def test_places_and_bounds(prose):
    text = f"{prose(30, 1)}\nReleased under the MIT License.\n{prose(30, 2)}"
    [(name, score, start, end)] = lic.scan(text, KNOWN)
    assert (name, score, text[start:end]) == ("MIT", 1.0, "Released under the MIT License.")
    for a in range(1, 300):
        for b in (4, 40, 200):
            assert KNOWN.near(a, b) == (2 * min(a, b) / (a + b) >= lic.THRESHOLD - 1e-12)


def test_odd_rows(docs, odd):
    rows = lic.scan_licenses(docs(odd)).collect()
    assert len(rows) == len(odd) and all(r.licenses == [] for r in rows)
    assert lic.scan_licenses(docs([])).collect() == []


def test_runs_of_paragraphs_and_words(prose):
    code = "\n".join(f"call_{i}({i})" for i in range(60))
    mit, apache = lic.TEMPLATES["MIT"][2], lic.TEMPLATES["Apache-2.0"][1]
    three = mit.replace("The above copyright", "\n\nThe above copyright").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    for name, text in (
        ("MIT", f"{three}\n\n{code}"),
        ("Apache-2.0", f"{apache}\n{code}"),
        ("Apache-2.0", f"{prose(300, 1)} {apache} {prose(300, 2)}"),
    ):
        assert [x[0] for x in lic.scan(text, KNOWN)][:1] == [name]
    [(_, score, start, end)] = [x for x in lic.scan(f"{prose(90, 1)} {mit} {prose(90, 2)}", KNOWN) if x[0] == "MIT"]
    assert score == 1.0 and f"{prose(90, 1)} {mit} {prose(90, 2)}"[start:end] == mit[:-1]


def test_long_texts_are_linear():
    import time

    templates = lic.Templates(lic.TEMPLATES)
    mit = max(lic.TEMPLATES["MIT"], key=len).replace("\n", " ")
    near = mit.replace("software", "thing", 1) + " "
    for text in ("---\n" * 250_000, "\n" * 1_000_000, "the software " * 77_000, (mit + " and more ") * 900, near * 900):
        start = time.process_time()
        lic.scan(text, templates)
        assert time.process_time() - start < 8


def test_best_run_equals_all_runs():
    """The pruned search against every start and end."""
    import random

    templates = lic.Templates(lic.TEMPLATES)
    rng = random.Random(4)
    words = max(lic.TEMPLATES["MIT"], key=len).split()
    for _ in range(12):
        changed = [rng.choice(["x", "the", "software"]) if rng.random() < 0.12 else w for w in words]
        text = " ".join(["foo"] * rng.randrange(20) + changed + ["bar"] * rng.randrange(20) + changed[: rng.randrange(60)])
        placed = lic.placed_words(text)
        pairs = [(a[0], b[0]) for a, b in zip(placed, placed[1:])]
        best = {}
        for number, name in enumerate(templates.names):
            counts, size = templates.counts[number], templates.sizes[number]
            inside = [i for i, p in enumerate(pairs) if p in counts]
            for a in range(len(inside)):
                for b in range(a, len(inside)):
                    run = Counter(pairs[i] for i in inside[a : b + 1])
                    n = inside[b] - inside[a] + 1
                    if 2 * min(n, size) < templates.threshold * (n + size):
                        continue
                    dice = 2 * sum(min(c, counts[p]) for p, c in run.items()) / (n + size)
                    if dice >= templates.threshold:
                        best[name] = max(dice, best.get(name, 0.0))
        assert {name: found[0] for name, found in templates.runs(text, set()).items()} == best

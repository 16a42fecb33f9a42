"""The stages on their own inputs, against plain versions where SQL cannot follow."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_linededup import by_hand as lines_by_hand
from test_simhash import by_hand as fingerprint_by_hand
from test_simhash import components

from millrace.llm import quality

COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Every stage's input and output, written as the pipeline writes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(n))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(sorted(s.columns) == COLUMNS for s in stages[:-1])


def test_rejected_by_the_classifier(spark, sf_dir, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {k for k, t in rows(stages[0]).items() if model.tails(quality.features(t))[1] >= 0.5}
    assert set(rows(stages[1])) == want and len(want) > 100


def test_lines_cut(stages):
    before, after = rows(stages[1]), rows(stages[2])
    gone = lines_by_hand(list(before.items()))
    for k, t in before.items():
        left = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone.get((k, t), []))
        assert after.get(k, "") == (left if left.strip(" \t\n\r\x0b\x0c") else "")
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_no_line_variants_are_broadcast(spark, sf_dir, stages):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = corpus_pipeline.drop_repeated_lines(spark, stages[1], sf_dir)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def made(node, sent=False):
        """Python nodes, each with whether its rows are broadcast before they are shuffled."""
        name = node.nodeName()
        sent = name == "BroadcastExchange" or (sent and name != "Exchange")
        own = [sent] if name == "MapInArrow" else []
        return own + [x for i in range(node.children().size()) for x in made(node.children().apply(i), sent)]

    found = made(plan)
    assert found and not any(found)


def test_one_of_each_group(stages):
    before = sorted(rows(stages[2]).items())
    names = components([k for k, _ in before], [fingerprint_by_hand(t) for _, t in before])
    assert set(rows(stages[3])) == set(names)


def test_benchmark_text_gone(spark, sf_dir, stages):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(len(w) - 9)}
    want = {k for k, t in rows(stages[3]).items() if not any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))}
    assert set(rows(stages[4])) == want


def test_mix(stages):
    mixed = stages[5].collect()
    assert {r.doc_id for r in mixed} == set(rows(stages[4]))
    held, took, target = Counter(), Counter(), {}
    for r in mixed:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r.taken <= 2 * r.size
        held[r.source] += r.size
        took[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(held.values()))
    assert all(abs(took[s] - target[s]) <= 0.03 * target[s] + 2 for s in held)


def test_run_equals_the_stages(spark, sf_dir, stages):
    key = ["doc_id", "taken"]
    assert sorted(corpus_pipeline.run(spark, sf_dir).select(*key).collect()) == sorted(stages[5].select(*key).collect())


def test_odd_inputs(spark, sf_dir, docs, odd):
    for given in (docs(odd), docs([])):
        out = given
        for _, stage in corpus_pipeline.STAGES:
            out = spark.createDataFrame(stage(spark, out, sf_dir).collect(), stage(spark, out, sf_dir).schema)
        assert set(given.columns) - {"size"} <= set(out.columns)

import zlib

import numpy as np

from millrace.llm import langid


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    network = langid.ByteNetwork(["a", "b", "c"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    windows = rng.integers(97, 110, (6, langid.LENGTH)).astype(np.uint8)
    targets = rng.integers(0, 3, 6)

    def loss():
        return -network.forward(windows)[np.arange(6), targets].mean()

    found = network.gradients(windows, targets)
    for name, grad in found.items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        kept = network.weights[name][at]
        network.weights[name][at] = kept + 1e-5
        up = loss()
        network.weights[name][at] = kept - 1e-5
        down = loss()
        network.weights[name][at] = kept
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-5, name


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = langid.op3_language_id(spark, folder).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_windows_cover_the_whole_text():
    text = "Ab é1" * 100
    raw = text.lower().replace("1", "\0").replace(" ", "\0").encode()
    assert langid.windows_of(text).tobytes().rstrip(b"\0") == raw.rstrip(b"\0")


def test_odd_rows(docs, odd):
    df = docs(odd + [(50, "12 34 !?")])
    rows = langid.predict_language(df, langid.train(df)).collect()
    assert len(rows) == len(odd) + 1
    by_key = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by_key[3] == by_key[4] == by_key[5] == by_key[50] == ("und", 0.0)
    assert by_key[7][0] == "en"


def test_nothing_to_learn_from(docs):
    empty = docs([])
    assert langid.train(empty) is None
    assert langid.predict_language(docs([(1, "text")]), None).first().lang_pred == "und"
    assert langid.predict_language(empty, None).collect() == []

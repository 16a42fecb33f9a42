import zlib

import numpy as np

from millrace.llm import quality


def triples(found):
    return (
        np.repeat(np.arange(len(found)), [len(f) for f in found]),
        np.concatenate([np.fromiter(f, np.int64, len(f)) for f in found]),
        np.concatenate([np.fromiter(f.values(), float, len(f)) for f in found]),
    )


def test_model_orders_grades(prose):
    texts = [prose(60, i) + " bad" * n for i in range(90) for n in ((0, 4, 20)[i % 3],)]
    grades = np.array([(2, 1, 0)[i % 3] for i in range(90)])
    model = quality.OrdinalModel().fit(*triples([quality.features(t) for t in texts]), grades)
    assert model.thresholds[0] < model.thresholds[1]
    expected = [sum(model.tails(quality.features(prose(60, 500 + i) + " bad" * n))) for i in range(10) for n in (0, 4, 20)]
    clean, some, many = (np.mean(expected[k::3]) for k in range(3))
    assert clean > 1.7 and 0.6 < some < 1.4 and many < 0.3


def test_held_out_documents(spark):
    """Documents of the fold that is not learnt from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    asked = labels.join(docs, "doc_id").filter(~quality.training_fold(docs["doc_id"]))
    rows = quality.grade_texts(asked, model).join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.tails[1] >= 0.5 for r in rows if r.quality == 1 and r.toxic == 0]
    poor = [r.tails[1] < 0.5 for r in rows if r.quality == 0]
    toxic = [r.tails[1] < 0.5 for r in rows if r.quality == 1 and r.toxic == 1]
    assert np.mean(good) > 0.97 and np.mean(poor) > 0.97 and np.mean(toxic) > 0.8
    assert all(r.tails[0] >= r.tails[1] for r in rows)


def test_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, None), (None, 1, 0), (6, 0, 0), (6, 0, 0)], "doc_id long, quality long, toxic long")
    df = docs(odd)
    rows = quality.grade_texts(df, quality.fit(df, labels)).collect()
    assert len(rows) == len(odd)
    assert all(r.expected_grade == 0 for r in rows if r.doc_id in (3, 4, 5))
    kept = quality.accepted(df, None)
    assert kept.columns == df.columns and kept.count() == len(odd) - 3


def test_nothing_to_learn_from(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert quality.fit(docs([(1, "a")]), labels) is None
    assert quality.accepted(docs([]), None).collect() == []

import random
import zlib

import numpy as np

from lexmill.llm import quality
from tests.llm.helpers import frame, odd_rows, prose


def corpus(n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(5, 200)) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in prose(rng, 60).split()), prose(rng, 1) * 1 + (" " + prose(rng, 1)) * 0 + " same" * 80, " | ".join(prose(rng, 70).split())])
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    got = quality.classify(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: q for d, q, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_density_gap_against_direct_formula():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(size=(50, 3)), rng.normal(loc=1, size=(70, 3))
    acc = [np.array([50.0, 70.0]), np.stack([x0.sum(0), x1.sum(0)]), np.stack([x0.T @ x0, x1.T @ x1])]
    m = quality.Discriminant(*acc)
    for x in rng.normal(size=(5, 3)):
        d = []
        for c in (0, 1):
            cov = m.factor[c] @ m.factor[c].T
            z = x - m.mean[c]
            d.append(-0.5 * (z @ np.linalg.inv(cov) @ z + np.log(np.linalg.det(cov))))
        want = 1 / (1 + np.exp(-((d[1] - d[0]) / quality.TEMPER + np.log(m.prior / (1 - m.prior)))))
        assert np.isclose(m.score(x[None])[0], want)


def test_odd_rows_and_missing_classes(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, extra=True), none).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 1, 0), (2, 0, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(frame(spark), odd).collect()) == len(odd_rows())
    assert quality.classify(frame(spark, []), none).collect() == []
    docs, labels = corpus(100)
    kept = quality.accepted(frame(spark, docs, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == frame(spark, docs, extra=True).columns and 0 < kept.count() < 100

import random
import zlib

import numpy as np
from llm_helpers import frame, prose
from pyspark.sql import functions as F

from timberline.llm import toxicity


def corpus(n=1200):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words, bad = prose(k, 40).split(), k % 8 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["vile", "nasty", "horrid"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_bound(spark):
    rows, labels = corpus()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in out) / len(out) > 0.97
    kept = toxicity.clean(docs, toxicity.fit(docs, marks))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted} and kept.columns == docs.columns
    assert toxicity.fit(docs, marks, max_labelled=50).count() >= 1


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = frame(spark, rows)
    a, b = (sorted(map(tuple, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped))
    assert a == b and a


def test_learning_rate_is_by_coordinate_and_l1_is_sparse():
    m = toxicity.Ftrl(bits=8)
    for _ in range(50):
        m.learn(np.array([0, 5, 9], np.int32), 1)
        m.learn(np.array([0, 6], np.int32), 0)
    w = m.weights()
    assert w[5] > 0 > w[6] and w[7] == 0 and (w[10:] == 0).all()


def test_features_are_words_pairs_and_skips():
    doc, at = toxicity.features(["A b c", "", "a B C"])
    assert (doc == 0).sum() == (doc == 2).sum() == 3 + 2 + 1 and not (doc == 1).any()
    assert sorted(at[doc == 0]) == sorted(at[doc == 2])
    long = ["w" * 30 + "x" * 10, "w" * 30 + "y" * 10]
    assert len(set(toxicity.features(long)[1].tolist())) == 2


def test_awkward_rows(spark, awkward, none):
    marks = spark.createDataFrame([(None, 1), (4, None), (3, 7), (4, 0), (4, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, marks)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    empty = toxicity.fit(none, marks)
    assert empty.count() == 0 and {r.score for r in toxicity.score(awkward, empty).collect()} == {0.0}
    assert toxicity.clean(awkward, empty).count() == awkward.count() and toxicity.score(none, model).count() == 0
    assert toxicity.clean(awkward, model).where(F.col("text").isNull()).count() in (0, 2)


def test_ftrl_equals_the_textbook_form():
    """Coordinate by coordinate, as published: z, n, sigma and the closed form of the weights."""
    r, alpha, beta, l1, l2 = random.Random(9), 0.7, 1.0, 0.5, 0.2
    model, z, n = toxicity.Ftrl(6, alpha, beta, l1, l2), {}, {}
    for _ in range(400):
        active, y = sorted({0, *r.sample(range(1, 64), r.randint(0, 6))}), r.randint(0, 1)
        w = {}
        for i in active:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            if i == 0:
                w[i] = -zi * alpha / (beta + ni**0.5)
            else:
                w[i] = 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((beta + ni**0.5) / alpha + l2)
        g = 1 / (1 + 2.718281828459045 ** -sum(w.values())) - y
        for i in active:
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
        model.learn(np.array(active, np.int32), y)
    assert np.allclose(model.z, [z.get(i, 0.0) for i in range(64)]) and np.allclose(model.n, [n.get(i, 0.0) for i in range(64)])
    assert (model.weights() != 0).sum() > 10


def test_features_held_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_pydict({"features": [np.array(f, "<i4").tobytes() for f, _ in rows], "label": [y for _, y in rows]})

    rows = [([5, 6], 1), ([7], 0), ([8, 9, 10], 1)]
    weights = lambda b: [r.to_pydict() for r in toxicity._fit(iter(b), 2)]
    monkeypatch.setattr(toxicity, "MAX_FEATURE_BYTES", 12)
    assert weights([batch(rows)]) == weights([batch(rows[:1]), batch(rows[1:2])]) and weights([]) == []


def test_calibration_is_steady_where_margins_part_the_labels():
    labels = np.array([0] * 500 + [1] * 60)
    slope, shift = toxicity.calibration(np.where(labels == 1, 0.4, -0.3), labels)
    p = 1 / (1 + np.exp(-(slope * np.array([0.4, -0.3]) + shift)))
    assert abs(p[0] - 61 / 62) < 1e-6 and abs(p[1] - 1 / 502) < 1e-6
    r = np.random.default_rng(2)
    m = r.normal(size=4000) * 3
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 * m - 1)))).astype(int)
    slope, shift = toxicity.calibration(m, y)
    assert abs(slope - 0.5) < 0.06 and abs(shift + 1) < 0.15
    assert toxicity.calibration(m[:10], y[:10]) == (1.0, 0.0)

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, words
from tidemark.llm import toxicity as X


def corpus(n=900):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        w = words(60, k, 3000)
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["Vile", "rotten", "zzslur" + r.choice("abcdef") + str(r.randrange(99))])
        rows.append((k, " ".join(w)))
        if r.random() < 0.5:
            labels.append((k, int(toxic)))
    return rows, labels, None


def test_held_out_accuracy(spark):
    rows, labels, _ = corpus()
    d = docs(spark, [*rows, (5000, None), (5001, ""), ("null", "vile rotten zzslura1 " * 3000)])
    lab = spark.createDataFrame([*labels, (None, 1), (99999, 1), (3, None)], "doc_id long, toxic int")
    model = X.learn(d, lab, X.fold(F.col("doc_id")) != 0)
    got = {r.doc_id: r.toxicity for r in X.score(d, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] < 0.5 and got[None] > 0.5
    test = [(k, t) for k, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    right = [(got[k] >= 0.5) == bool(t) for k, t in test]
    assert len(test) > 60 and np.mean(right) > 0.95


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", X.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def sparse(x):
    row, place = np.nonzero(x)
    return X.Sparse(np.searchsorted(row, np.arange(len(x) + 1)), place, x[row, place])


def test_training_finds_what_separates():
    """With the true prior the corrected risk finds the separating feature though U holds positives."""
    r = np.random.default_rng(2)
    p = np.stack([np.ones(300), r.random(300) < 0.5], axis=1).astype(np.float32)
    u = np.stack([np.arange(1000) < 200, r.random(1000) < 0.5], axis=1).astype(np.float32)
    bias, w = X.train(sparse(p), sparse(u), 0.2, 2)
    score = X.sigmoid(bias + u @ w)
    assert (score[:200] > 0.5).all() and (score[200:] < 0.5).all()


def test_risk_and_gradient_match_brute_force():
    """The estimator's terms by loops over documents, and its gradient by differences, on both sides of zero."""
    r = np.random.default_rng(5)
    seen = set()
    for _ in range(20):
        p, u = (r.integers(0, 2, (n, 4)) * r.random((n, 4)) for n in (7, 9))
        w, prior = r.normal(0, 3, 5), r.uniform(0.1, 0.8)

        def terms(w, p=p, u=u, prior=prior):
            def loss(rows, sign):
                return sum(math.log1p(math.exp(-sign * (w[0] + sum(a * b for a, b in zip(x, w[1:]))))) for x in rows) / len(rows)

            return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

        positive, negative, got = X.risk_and_gradient(sparse(p), sparse(u), prior, w)
        assert np.allclose((positive, negative), terms(w))
        seen.add(negative >= 0)
        for k in range(5):
            h = np.eye(5)[k] * 1e-6
            (a1, b1), (a0, b0) = terms(w + h), terms(w - h)
            want = (a1 + b1 - a0 - b0) / 2e-6 if negative >= 0 else -(b1 - b0) / 2e-6
            assert abs(got[k] - want) < 1e-5
    assert seen == {True, False}


def test_features_match_counting():
    from collections import Counter

    texts = ["Bad words, bad bad BAD", "", None, "längerer Wörterbuchartikel " * 2, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字"]
    row, place = X.Parts().features(texts)
    for k, x in enumerate(texts):
        count = Counter()
        for w in X.ascii_words((x or "").lower()):
            count.update([w, *(w[:n] + b"-" for n in range(4, min(8, len(w) - 1) + 1))])
        assert (row == k).sum() == sum(n >= t for n in count.values() for t in X.TIMES), x
    again = X.Parts()
    again.most = 1
    for k, x in enumerate(texts):
        assert sorted(again.features([x])[1].tolist()) == sorted(place[row == k].tolist())


def test_empty_tables_and_columns(spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    d = docs(spark, ["a", "b"]).withColumnRenamed("lang", "p").withColumnRenamed("source", "u")
    model = X.learn(d, lab)
    assert all(r.toxicity < 0.01 for r in X.score(d, model).collect())
    assert X.score(empty(spark), model).count() == 0
    assert X.learn(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).weights.any() == False  # noqa: E712


def test_learning_uses_no_other_columns(spark):
    rows, labels, _ = corpus(300)
    d = docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = X.learn(d, lab), X.learn(d.withColumn("lang", F.lit("x")).repartition(7), lab)
    assert a.bias == b.bias and (a.weights == b.weights).all() and a.weights.any()

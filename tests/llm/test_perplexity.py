import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, prose
from tidemark.llm import perplexity as P


def brute_model(texts):
    """Interpolated modified Kneser-Ney by the textbook, over word classes."""
    c = Counter()
    for x in texts:
        s = P.sequence(x).tolist()
        c.update(zip(s, s[1:]))
    followers, preceders = defaultdict(list), Counter()
    for (v, w), n in c.items():
        followers[v].append(n)
        preceders[w] += 1

    def discounts(values):
        n = [max(sum(1 for v in values if v == j), 1) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]

    d, dk = discounts(c.values()), discounts(preceders.values())
    every = sum(preceders.values())
    rest = sum(dk[min(n, 3)] for n in preceders.values()) / every / P.CLASSES

    def p1(w):
        n = preceders[w]
        return max(n - dk[min(n, 3)], 0) / every + rest

    def p(v, w):
        if v not in followers:
            return p1(w)
        total = sum(followers[v])
        back = sum(d[min(n, 3)] for n in followers[v]) / total
        n = c[v, w]
        return max(n - d[min(n, 3)], 0) / total + back * p1(w)

    return p


def texts():
    good = [prose(80, k, 150) for k in range(60)]
    return good + ["zz " * 60, " ".join(f"junk{k}" for k in range(80)), None, "", "  \n", "w1", prose(30_000, 5, 300), good[3], good[3]]


def test_matches_the_textbook(spark):
    xs = texts()
    rows = [*enumerate(xs), (3, xs[3])]  # a row twice
    lab = spark.createDataFrame([(k, 1 if k < 40 else 0) for k in range(60)] + [(None, 1), (9999, 1), (5, None)], "doc_id long, quality int")
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 0]
    p = brute_model([x for k, x in rows if k is not None and k < 40 and k not in held])
    got = P.perplexities(docs(spark, rows).repartition(3), lab, quantile=0.9).select("doc_id", "__lm.*").collect()
    assert len(got) == len(rows)
    want = {}
    for k, x in rows:
        s = P.sequence(x).tolist()
        want[k] = math.exp(-sum(math.log(p(v, w)) for v, w in zip(s, s[1:])) / (len(s) - 1)) if s else None
    for r in got:
        if want[r.doc_id] is None:
            assert r.perplexity is None and not r.kept and r.n_words == 0
        else:
            assert abs(r.perplexity / want[r.doc_id] - 1) < 1e-3
            assert r.kept == (r.perplexity <= r.threshold)
    limit = {r.threshold for r in got}
    assert len(limit) == 1 and limit.pop() in [pytest.approx(want[k], rel=1e-3) for k in held]
    kept = {r.doc_id for r in got if r.kept}
    assert 61 not in kept and {k for k in range(40)} - set(held) <= kept


def test_probabilities_add_up(spark):
    xs = [prose(60, k, 40) for k in range(10)]
    d = spark.createDataFrame([(x,) for x in xs], "text string")
    model, known = P.train(d)
    key = np.concatenate([P.unpacked(r["keys"]) for r in known.collect()])
    n = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in known.collect()]).astype(int)
    for v in {int(k >> np.uint64(P.BITS)) for k in key[:50]}:
        own = (key >> np.uint64(P.BITS)) == v
        back = np.exp(model.local[v] - np.log(model.unigram[v]))
        p = back * model.unigram.astype(float)
        p[(key[own] & P.MASK).astype(int)] *= np.exp(model.gain(key[own], n[own]))
        assert abs(p.sum() - 1) < 2e-3


def test_languages_have_their_own_thresholds(spark):
    d = docs(spark, [prose(60, k, 150 if k % 2 else 1500) for k in range(100)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx"))
    lab = spark.createDataFrame([(k, 1) for k in range(100)], "doc_id long, quality int")
    got = {r.lang: r["__lm"].threshold for r in P.perplexities(d, lab).collect()}
    assert got["xx"] > got[None]


def test_no_labels_and_empty_tables(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    got = P.perplexities(docs(spark, ["a b", None]), lab).collect()
    assert [r["__lm"].kept for r in sorted(got, key=lambda r: r.doc_id)] == [True, False]
    assert P.perplexities(empty(spark), lab).count() == 0


def test_clashing_columns(spark):
    d = docs(spark, [prose(60, k, 150) for k in range(30)]).withColumnRenamed("source", "rk").withColumnRenamed("n_chars", "gain").withColumn("t", F.lit(1))
    lab = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    out = P.perplexities(d, lab)
    assert out.columns[-1] == "__lm" and set(out.columns[:-1]) == set(d.columns) and all(r["__lm"].perplexity > 1 for r in out.collect())


def test_packing():
    key = np.array([0, 1, (1 << 44) - 1, 12345678901], np.uint64)
    assert (P.unpacked(P.packed(key)) == key).all()

import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import docs, empty, prose
from tidemark.llm import suffix_dedup as S


def brute(rows):
    """rows: (id, text); bytes covered by a window that a smaller id has."""
    holders = {}
    for i, x in rows:
        b = (x or "").encode()
        for p in range(len(b) - S.WINDOW + 1):
            w = b[p : p + S.WINDOW]
            holders[w] = min(holders.get(w, i), i)
    out = []
    for i, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - S.WINDOW + 1):
            if holders[b[p : p + S.WINDOW]] < i:
                gone[p : p + S.WINDOW] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def rows():
    r = random.Random(2)
    passages = [prose(30, 500 + k) for k in range(4)]
    out = []
    for k in range(60):
        x = prose(40 + k, k)
        if k % 3 == 0:
            x = x[: 5 * k] + passages[k % 4][r.randrange(40) :] + x[5 * k :]
        out.append((k, x))
    out += [(60, out[5][1]), (61, out[5][1]), (62, None), (63, ""), (64, "abc" * 200), (65, "abc" * 100 + "x"), (66, "a" * 49), (67, "a" * 50), (68, "a" * 51), (69, "é" * 100), (70, "é" * 60), (71, "a\x00" * 60), (72, "a\x00" * 40)]
    return out + [(70, "é" * 60), (5, out[7][1]), (-3, out[9][1])]


@pytest.mark.parametrize("batch,shard", [(10_000, S.SHARD_BYTES), (7, 300)])
def test_matches_brute_force(spark, monkeypatch, batch, shard):
    """Also with many small batches and shards, so that equal windows must meet across them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(S._sort_shards, "__defaults__", (shard,))
    xs = rows()
    random.Random(1).shuffle(xs)
    try:
        got = sorted(tuple(r) for r in S.suffix_dedup(docs(spark, xs).repartition(5)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(xs)


def test_suffix_order_and_common_prefixes():
    r = random.Random(1)
    words = [b"the ", b"of ", b"tion", b"ing "]
    base = b"".join(r.choice(words) for _ in range(200))
    for data in (b"".join(base[a : a + 120] for a in (0, 50, 50, 300, 7)), b"a" * 700 + b"b" + b"a" * 90, bytes(300), b"x" * 51):
        x = np.frombuffer(data, np.uint8)
        order, slot = S.suffix_array(x)
        cut = [data[p : p + S.WINDOW] for p in order if p + S.WINDOW <= len(data)]
        assert cut == sorted(cut) and (order[slot] == np.arange(len(x))).all()
        common = S.kasai(x, order, slot, strips=7)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < S.WINDOW and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert common[b] == n
        label = S.window_classes(x)
        windows = {(data[p : p + S.WINDOW], label[p]) for p in range(len(data) - S.WINDOW + 1)}
        assert len(windows) == len({w for w, _ in windows}) == len({c for _, c in windows})


def test_anchors_of_equal_windows_agree_across_pieces(monkeypatch):
    text = prose(400, 3).encode()

    def by_window(x):
        return {x[p : p + S.WINDOW]: int(k) for _, k, a, b in zip(*S.doc_anchors([x])) for p in range(a, b + 1)}

    whole = by_window(text)
    monkeypatch.setattr(S, "CHUNK", 130)
    pieces = by_window(b"zz" + text)
    assert len(whole) == len(set(whole)) and all(pieces[w] == k for w, k in whole.items())


def test_keys_spread_over_shards():
    _, key, _, _ = S.doc_anchors([prose(20_000, 3, 100_000).encode()])
    shard = ((key >> np.uint64(40)) * np.uint64(16) >> np.uint64(24)).astype(int)
    assert np.bincount(shard, minlength=16).max() < 2 * len(key) / 16


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "_roll", lambda data, width: np.zeros(len(data) - width + 1, np.uint64))
    a, b = b"a" * 50, b"b" * 50
    meta = np.array([[1, 11, 0, 0], [2, 12, 0, 0], [3, 13, 5, 5]])
    assert S.imported(S.exported(np.array([7, 9]), np.array([1, 2]), np.array([1, 0]), np.array([3, 0]), np.array([5, 0]), [a, b + b]))[0].tolist() == [[9, 2, 3, 5], [7, 1, 0, 0]]
    got = S.merged(meta, np.frombuffer(a + b + b, np.uint8)).to_pydict()
    assert got["rk"] == [13] and np.frombuffer(got["data"][0], "<i4").tolist() == [5, 5]


def test_null_ids_empty_tables_and_kept_text(spark):
    text = prose(30, 1)
    got = {r.id: r for r in S.suffix_dedup(docs(spark, [("null", text), (1, text), (2, "own")]), keep_text=True).collect()}
    assert got[None].n_removed == 0 and got[1].n_removed == len(text.encode()) and bytes(got[1].kept) == b"" and bytes(got[2].kept) == b"own"
    assert S.suffix_dedup(empty(spark)).count() == 0


def test_clashing_columns(spark):
    text = prose(30, 1)
    d = docs(spark, [(1, text), (2, text), (2, text)]).withColumnRenamed("lang", "rk").withColumnRenamed("source", "t").withColumnRenamed("n_chars", "id")
    assert sorted((r.id, r.n_removed) for r in S.suffix_dedup(d).collect()) == [(1, 0), (2, len(text.encode())), (2, len(text.encode()))]

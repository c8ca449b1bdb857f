import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, words
from tidemark.llm import components as components_module
from tidemark.llm import jaccard_join as J
from tidemark.llm.common import ascii_words, written
from tidemark.llm.components import components


def brute(rows, level=0.8):
    """(id, class id, links, group id) by comparing all pairs of sets."""
    sets = {}
    for i, x in rows:
        w = ascii_words(x)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    classes = defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[s].append(i)
    reps = list(classes)
    links, parent = defaultdict(int), list(range(len(reps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(reps)):
        for b in range(a):
            n = len(reps[a] & reps[b])
            if n / (len(reps[a]) + len(reps[b]) - n) >= level:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    group = defaultdict(lambda: 10**9)
    for a, s in enumerate(reps):
        group[find(a)] = min(group[find(a)], min(classes[s]))
    where = {s: a for a, s in enumerate(reps)}
    return sorted((i, None if not s else min(classes[s]), 0 if not s else links[where[s]], i if not s else group[find(where[s])]) for i, s in sets.items())


def rows():
    r = random.Random(4)
    out = []
    for k in range(40):
        base = words(40 + 3 * k, k, 5000)
        out.append(" ".join(base))
        for _ in range(k % 4):
            x = list(base)
            for _ in range(r.randrange(0, 5)):
                x[r.randrange(len(x))] = f"new{r.random()}".replace(".", "")
            out.append(" ".join(x).upper() + "!")
    hot = words(120, 999, 5000)
    for k in range(60):  # many near copies of one text
        x = list(hot)
        x[k] = f"edit{k}"
        out.append(" ".join(x))
    out += [None, "", "...", "one two", "One, two!", "one two three", "a b c d e", "same " * 200, "same " * 300, out[3], out[3]]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [J.BLOCK, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    """With blocks of seven, hot nodes and components are dealt into many."""
    monkeypatch.setattr(J, "BLOCK", block)
    xs = rows()
    got = J.jaccard_groups(docs(spark, xs).repartition(3)).select("id", "class_id", "n_links", "group_id").collect()
    assert sorted(map(tuple, got), key=lambda t: t[0]) == brute(xs)


def test_two_members_dealt_by_their_shingles_count_one_link(spark, monkeypatch):
    """Blocks by shingles leave a component of two with an empty block in about half of all cases."""
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 150)
    xs = []
    for k in range(12):
        base = words(100, 500 + k, 5000)
        xs += [" ".join(base), " ".join([*base, "more"])]
    xs = list(enumerate(xs))
    got = J.jaccard_groups(docs(spark, xs)).select("id", "class_id", "n_links", "group_id").collect()
    assert sorted(map(tuple, got)) == brute(xs) and all(r.n_links == 1 for r in got)


def test_a_large_cluster_of_near_copies(spark):
    """5,000 different texts near one another: all pairs are links, and no task holds the cluster."""
    base = words(120, 77, 100_000)
    xs = [(k, " ".join([*base[: k % 120], f"only{k}", *base[k % 120 + 1 :]])) for k in range(5000)]
    got = J.jaccard_groups(docs(spark, xs)).select("n_links", "group_id").distinct().collect()
    # 116 shingles, of which an edit changes five at most: 106 or more of 126 are common
    assert [tuple(r) for r in got] == [(4999, 0)]
    plan = J._dealt(spark.createDataFrame([(b"a", bytes([k % 256, k // 256]), 11) for k in range(5000)], "comp binary, c binary, nb int"), "nb", "comp")
    sizes = [r["count"] for r in plan.groupBy("g").count().collect()]
    assert len(sizes) == 66 and max(sizes) < 1100


def test_the_walk_shortens_only_where_classes_are_apart(spark, monkeypatch):
    """Whole labels connect a tight cluster; nodes of the least depth then hold nothing to compare."""
    seen = []
    monkeypatch.setattr(J, "components", lambda e: seen.append(e.count()) or components(e))
    base = words(200, 5, 100_000)
    xs = [(k, " ".join([*base, f"tail{k}"])) for k in range(50)]
    assert J.jaccard_groups(docs(spark, xs)).where("n_links = 49").count() == 50
    # one step of the walk, then the links themselves: 49 of the star of verified ones
    assert len(seen) == 2 and seen[0] >= 49 and seen[1] == 49


def test_overlaps_match_sets():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))) for _ in range(30)]
    got = J.overlaps(sets)
    for a in range(30):
        for b in range(30):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_wordless_rows_all_stay(spark):
    xs = [(1, "..."), (1, "..."), (2, ""), (2, ""), (3, "\n"), (3, "\n"), (4, None), (4, None), (5, "two words"), (5, "two words")]
    got = sorted(r.doc_id for r in J.one_of_each(docs(spark, xs)).collect())
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_very_long_texts(spark):
    base = words(60_000, 9, 10**6)
    xs = [(0, " ".join(base)), (1, " ".join([*base[:30_000], "x", *base[30_000:]])), (2, " ".join(words(60_000, 10, 10**6)))]
    got = sorted(map(tuple, J.jaccard_groups(docs(spark, xs)).select("id", "class_id", "n_links", "group_id").collect()))
    assert got == [(0, 0, 1, 0), (1, 1, 1, 0), (2, 2, 0, 2)]


def test_one_of_each_keeps_the_first(spark):
    xs = rows()
    d = docs(spark, [*xs, xs[0], ("null", "fresh words that nobody else has at all")]).withColumnRenamed("lang", "c").withColumnRenamed("source", "g")
    out = J.one_of_each(d)
    want = sorted({g for _, _, _, g in brute(xs)})
    got = [r.doc_id for r in out.collect()]
    assert out.columns == d.columns and sorted(i for i in got if i is not None) == want and got.count(None) == 1
    assert J.one_of_each(empty(spark)).count() == 0 and J.jaccard_groups(empty(spark)).count() == 0


def test_prefix_shortens_to_the_recall():
    assert J.prefix_for(0.8, 0.9, depth=6) == 6 and J.prefix_for(0.8, 0.99999) == 5 and J.prefix_for(0.95, 0.99999, depth=6) == 6
    assert J.prefix_for(0.8, 0.9) == 8 and J.prefix_for(0.8, 0.999) == 7 and J.prefix_for(0.8, 0.9999) == 5
    with pytest.raises(ValueError):
        J.prefix_for(0.1, 0.99999)


def test_minima_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(-(1 << 62), 1 << 62, 3000)
    b = np.concatenate([a[:2400], r.integers(-(1 << 62), 1 << 62, 300)])
    m = J.signatures([np.unique(a), np.unique(b)])
    true = 2400 / 3300
    assert abs((m[0] == m[1]).mean() - true) < 0.11


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(5, 5)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_are_never_rows(spark):
    plan = J.jaccard_groups(docs(spark, rows())).select(F.sum("n_links"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_few_edges_take_few_jobs(spark):
    """Rounds of stars over a handful of edges are stages without work: on 211 partitions they took most of the time."""
    edges = written(spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long").repartition(7), "edges")
    made = []
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    try:
        got = components(edges).collect()
        made = context.statusTracker().getJobIdsForGroup("few edges")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.v: r.root for r in got} == dict.fromkeys(range(301), 0) and len(got) == 301
    assert len(made) <= 8


def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch):
    """Local forests, then rounds: the same as in one task."""
    r = random.Random(8)
    edges = spark.createDataFrame([(bytes([r.randrange(16), r.randrange(16)]), bytes([r.randrange(16), r.randrange(16)])) for _ in range(220)], "a binary, b binary").repartition(5)
    small = sorted((bytes(x.v), bytes(x.root)) for x in components(edges).collect())
    monkeypatch.setattr(components_module, "LOCAL", 20)
    assert sorted((bytes(x.v), bytes(x.root)) for x in components(edges).collect()) == small and len({x for _, x in small}) > 3

import re
from collections import Counter

from tests.llm.helpers import docs, empty, prose
from tidemark.llm import quality_rules as Q


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {k + j for k, t in enumerate(zip(ws, ws[1:], ws[2:])) if tri[t] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def texts():
    good = [prose(160 + k, k) for k in range(60)]
    return good + [
        None, "", " \n\t ", "a a a", "x y \x1c z\x85q", "same line here\n" * 30, "é# ü| <b> $$$", "\n\n", prose(20_000, 99),
        " ".join(w.upper() + "!!" for w in prose(120, 1).split()),
        " | ".join(prose(150, 2).split()), " ".join(w + "%%%" for w in prose(150, 3).split()), "spam eggs " * 90,
    ]


def test_counts_match_brute_force(spark):
    for x in texts():
        assert Q.measure(x)[:5] == brute(x)


def test_repeated_words_with_many_distinct_words():
    ws = [str(k).encode() for k in range(3000)] * 2
    assert Q.repeated_words(ws) == 6000
    assert Q.repeated_words(ws[:3000]) == 0


def test_posterior_separates_junk_and_keeps_clean(spark):
    xs = texts()
    rows = {r.doc_id: r for r in Q.quality_rules(docs(spark, xs)).select("doc_id", "text", "__quality.*").collect()}
    assert len(rows) == len(xs)
    for k in range(60):
        assert rows[k].kept and rows[k].posterior > 0.9
    for k in range(60, len(xs)):
        r, (n, _, _, _, rep) = rows[k], brute(xs[k])
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        if r.base_failed:
            assert not r.kept
    assert not any(rows[len(xs) - k].kept for k in range(1, 5))


def test_em_matches_an_independent_loop():
    import math

    counts = {1 * 3**0 + 2 * 3**1 + 1 * 3**2: 50, 0 * 3**0 + 0 * 3**1 + 1 * 3**2: 10, 1 * 3**0 + 2 * 3**1 + 0 * 3**2: 5, 2 + 3 * 2 + 9 * 2: 300}
    got = Q.fit(counts, 3, rounds=20)
    votes = {k: [(k // 3**j) % 3 - 1 for j in range(3)] for k in counts}
    good, bad, prior = [0.98] * 3, [0.3] * 3, 0.8

    def chances():
        post = {}
        for k, v in votes.items():
            yes, no = prior, 1 - prior
            for j, s in enumerate(v):
                yes *= good[j] if s > 0 else 1 - good[j] if s < 0 else 1
                no *= 1 - bad[j] if s > 0 else bad[j] if s < 0 else 1
            post[k] = yes / (yes + no)
        return post

    for _ in range(20):
        post = chances()
        for j in range(3):
            g = sum(counts[k] * post[k] for k in counts if votes[k][j])
            b = sum(counts[k] * (1 - post[k]) for k in counts if votes[k][j])
            good[j] = min(0.999, max(0.001, (sum(counts[k] * post[k] for k in counts if votes[k][j] > 0) + 98) / (g + 100)))
            bad[j] = (sum(counts[k] * (1 - post[k]) for k in counts if votes[k][j] < 0) + 30) / (b + 100)
            bad[j] = min(0.999, max(0.001, 1 - good[j], bad[j]))
        total = sum(counts.values())
        prior = (sum(counts[k] * post[k] for k in counts) + 80) / (total + 100)
    post = chances()
    assert all(math.isclose(got.posterior[k], post[k], abs_tol=1e-9) for k in counts)


def digits(*votes):
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def test_the_posterior_overrules_single_rules_both_ways():
    """A rule that speaks against good and bad texts alike is not heard; one that is hardly ever wrong
    outweighs three that see nothing. Fixed rates give other verdicts for both."""
    import numpy as np

    good, shouting = digits(1, 1, 1, 1, 1), digits(1, -1, -1, 1, 1)
    noise, junk = digits(-1, 1, 1, 1, 1), digits(-1, -1, -1, 1, 1)
    alone = digits(1, -1, 1, 1, 1)
    counts = {good: 8000, noise: 2000, shouting: 800, junk: 200, alone: 60, digits(1, 1, -1, 1, 1): 3}
    m = Q.fit(counts, 5)
    assert m.posterior[noise] > 0.9 and m.posterior[alone] < 0.5 and m.posterior[good] > 0.99 and m.posterior[shouting] < 0.01
    votes = np.array([[-1, 1, 1, 1, 1], [1, -1, 1, 1, 1]])
    fixed = Q.posteriors(votes, 0.8, np.full(5, 0.8), np.full(5, 0.8))
    assert fixed[1] > 0.5 and m.posterior[alone] < 0.5
    strict = [all(v >= 0 for v in row) for row in votes.tolist()]
    assert not strict[0] and m.posterior[noise] > 0.5
    assert m.on_good[0] < 0.85 and m.on_bad[1] > 0.9


def test_what_it_starts_from_is_outgrown():
    few, many = ({digits(-1, 1, 1): n // 2, digits(1, 1, 1): n // 2, digits(1, -1, -1): n // 4} for n in (20, 200_000))
    assert Q.fit(few, 3).on_good[0] > 0.85 and abs(Q.fit(many, 3).on_good[0] - 0.5) < 0.01


def test_texts_are_measured_once(spark):
    out = Q.quality_rules(docs(spark, texts()))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_empty_and_extra_columns(spark):
    assert Q.quality_rules(empty(spark)).count() == 0
    d = docs(spark, [prose(100, 1), None]).withColumnRenamed("lang", "pattern").withColumnRenamed("source", "n_words")
    out = Q.keep_good(d)
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [0]

import re

from tests.llm.helpers import docs, empty, words
from tidemark.llm import license_scan as S


def base(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for k in range(len(ws)):
            if ws[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def scan(spark, texts):
    return {r.doc_id: r for r in S.license_scan(docs(spark, texts)).select("doc_id", "__license.*").collect()}


def brute(text, k=4, slack=3, least=0.6):
    """Labels, score and spans, by comparing all places with all places of every template."""
    ws = S.ascii_words(text)
    spans, best = [], 0.0
    for label, wording in S.templates_of(k):
        tw = S.ascii_words(wording)
        places = {}
        for q in range(len(tw) - k + 1):
            places.setdefault(tuple(tw[q : q + k]), []).append(q)
        by_diagonal = {}
        for p in range(len(ws) - k + 1):
            for q in places.get(tuple(ws[p : p + k]), ()):
                by_diagonal.setdefault(p - q, set()).add(q)
        bands = []
        for d in sorted(by_diagonal):
            if not bands or d - bands[-1][-1] > slack:
                bands.append([])
            bands[-1].append(d)
        for band in bands:
            first = min(d + min(by_diagonal[d]) for d in band)
            end = max(d + max(by_diagonal[d]) for d in band) + k
            covered = len({q + j for d in band for q in by_diagonal[d] for j in range(k)})
            if end - first <= 2 * len(tw) + slack:
                best = max(best, covered / len(tw))
                if covered / len(tw) >= (1 if len(tw) < 12 else least):
                    spans.append((first, end, label, covered / len(tw)))
    return sorted({s[2] for s in spans}), best, sorted(spans)


def paragraph(label, start):
    return next(w for n, w in S.templates_of() if n == label and w.startswith(start))


def test_templates_are_whole_texts_that_tell_licenses_apart():
    got = S.templates_of()
    assert {n for n, _ in got} >= {"mit", "apache", "gpl", "mpl", "bsd", "isc", "zlib", "unlicense", "cc0", "artistic", "cc-by-nc"}
    assert len(got) > 250 and sum(len(w.split()) for n, w in got if n == "gpl") > 5000
    assert not any("WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT" in w for _, w in got)
    assert len(list(S.template_rows(4, got))) < 20_000


def test_base_and_method(spark):
    noise = " ".join(words(60, 1))
    mit = paragraph("mit", "Permission is hereby granted, free of charge")
    gap = mit.split()
    texts = [
        None, "", noise, f"{noise}. MIT license, mit. MIT-License! {noise}", "the GNU General\nPublic License; Apache License",
        f"{noise} Licensed under CC BY-NC 4.0. {noise}", f"{noise} {mit} {noise}",
        f"{noise} {' '.join(gap[:20] + ['really', 'so'] + gap[20:])} {noise}",  # two words more: neighbouring diagonals
        f"{noise} {' '.join(gap[:9])} {noise}", "general public " * 40, "Released under the MIT License. " * 3,
        f"{noise} " + paragraph("bsd", "Redistribution and use").upper(),
        f"{noise} {paragraph('gpl', 'This program is free software: you can')} {' '.join(paragraph('apache', '2. Grant of Copyright').split()[8:])} {noise}",
        " ".join(w for _, w in S.templates_of()), (noise + " " + mit + " ") * 200,
    ]
    got = scan(spark, [*texts, texts[6], texts[6]])
    for k, x in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r["labels"]) == base(x), k
        found, score, spans = brute(x)
        assert r.found == found and abs(r.score - score) < 1e-12 and 0 <= r.score <= 1, k
        assert [tuple(x) for x in r.spans] == spans, k
    assert got[2].found == [] and got[2].score == 0 and got[8].found == [] and got[9].found == []
    assert got[5].found == ["cc-by-nc"] and got[6].found == ["mit"] and got[7].found == ["mit"] and got[11].found == ["bsd"]
    assert got[12].found == ["apache", "gpl"] and len(got[14].spans) == 200
    span = got[6].spans[0]
    assert (span["first"], span["end"] - span["first"]) == (60, len(re.findall(r"\w+", mit))) and got[15].spans == got[6].spans == got[16].spans
    assert {s["first"] for s in got[10].spans if s["share"] == 1} == {0, 5, 10}


def test_rolling_hashes_are_of_words():
    h = S.Hashes()
    a = S.grams([b"a", b"b", b"c", b"d", b"a", b"b"], 2, h).tolist()
    assert a[0] == a[4] and len(set(a)) == 4 and a == S.grams([b"a", b"b", b"c", b"d", b"a", b"b"], 2, S.Hashes()).tolist()


def test_empty_and_clashing_columns(spark):
    assert S.license_scan(empty(spark)).count() == 0
    d = docs(spark, ["MIT license", "MIT license"]).withColumnRenamed("lang", "t").withColumnRenamed("source", "d")
    assert S.license_scan(d).count() == 2
    d = docs(spark, [("null", "Released under the MIT License"), ("null", "Released under the MIT License")]).withColumnRenamed("lang", "share").withColumnRenamed("source", "found")
    assert [r["__license"].found for r in S.license_scan(d).collect()] == [["mit"]] * 2

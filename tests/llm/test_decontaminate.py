import re

from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, words
from tidemark.llm import decontaminate as D


def split(x):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, width=8):
    ws, hit, names = split(text), set(), set()
    for i, x in items:
        iw = split(x)
        for w in ({tuple(iw[k : k + width]) for k in range(max(1, len(iw) - width + 1))} if iw else ()):
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    names.add(str(i))
    return len(ws), len(hit), sorted(names)


ITEMS = [(k, " ".join(words(30 + k, 1000 + k))) for k in range(12)] + [(90, "Short One"), (91, ""), (92, None), (93, "only,punctuation... here!"), (3, "w1 w2 w3")]


def texts():
    out = []
    for k in range(30):
        a = words(80, k, 30)
        item = split(ITEMS[k % 12][1])
        out.append(" ".join(a[:40] + item[k % 9 : k % 9 + 6 + k % 7] + a[40:]))
    out += [None, "", "!!! ...", "a SHORT one, b", "short", ITEMS[0][1] * 3, (ITEMS[1][1] + ". " + ITEMS[2][1]).upper(), ITEMS[4][1], "é " * 5000 + ITEMS[5][1]]
    return out + [out[3], out[3]]


def check(spark, **kw):
    xs = texts()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in D.hits(docs(spark, xs), items, "text", "h", **kw).select("doc_id", "h.*", D.n_hit("h.spans").alias("hit")).collect()}
    for k, x in enumerate(xs):
        assert (got[k].n_words, got[k].hit, got[k]["items"]) == brute(x, ITEMS), k


def test_matches_brute_force(spark):
    check(spark)


def test_other_widths(spark):
    xs = [x for x in texts() if x]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in D.hits(docs(spark, xs), items, "text", "h", width=3).select("doc_id", "h.*", D.n_hit("h.spans").alias("hit")).collect()}
    for k, x in enumerate(xs):
        assert (got[k].n_words, got[k].hit, got[k]["items"]) == brute(x, ITEMS, 3), k


def test_null_item_ids_hit_words_and_count_as_one(spark):
    items = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "one two three")], "item_id long, text string")
    rows = [("null", "zero one two three"), (1, "four five one two three"), (2, "four six"), (3, None)]
    got = {r.doc_id: (r.hit, r["items"]) for r in D.hits(docs(spark, rows), items, "text", "h").select("doc_id", "h.*", D.n_hit("h.spans").alias("hit")).collect()}
    assert got == {None: (3, ["7", None]), 1: (5, ["7", None]), 2: (0, []), 3: (0, [])}


def test_the_index_is_joined_and_what_is_broadcast_has_one_size(spark):
    items = spark.createDataFrame([(k, " ".join(words(40, k, 10**6))) for k in range(300)], "item_id long, text string")
    w = D._windows(items, "item_id", "text", 8)
    assert w.count() == 300 * 33
    assert len(D._bitmap(w.select(F.explode(F.split("w", " ")).alias("w")))) == D.BITS // 8
    m = D.Marked(D._bitmap(spark.createDataFrame([("straße",), ("a",)], "w string")))
    assert m(["straße".encode(), b"a", b"b", b"c"]) == {"straße".encode(), b"a"}
    plan = D.hits(docs(spark, texts()), items, "text", "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_clean_and_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = docs(spark, [ITEMS[0][1], "w1 only clean text", None]).withColumn("items", F.lit(1)).withColumn("n_words", F.lit(2))
    out = D.clean(d, items, min_items=1)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]
    assert D.clean(empty(spark), items).count() == 0
    assert D.clean(d, items.limit(0), min_items=1).count() == 3

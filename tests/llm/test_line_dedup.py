import random

from tests.llm.helpers import docs, empty
from tidemark.llm import line_dedup as L


def brute(rows, least):
    """rows: (id, text). A line goes if a run that has it, of ``least`` characters, starts earlier too."""
    distinct = sorted({(k, x) for k, x in rows if x is not None})
    seqs = [(k, x, x.split("\n")) for k, x in distinct]
    gone = {}
    first = {}
    for d, (_, _, ls) in enumerate(seqs):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                first.setdefault(tuple(ls[a:b]), (d, a))
    for d, (k, x, ls) in enumerate(seqs):
        out = set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(map(len, ls[a:b])) >= least and first[tuple(ls[a:b])] < (d, a):
                    out.update(range(a, b))
        gone[k, x] = out
    return gone


def test_matches_brute_force(spark):
    r = random.Random(5)
    pool = ["", "a", "bb", "short", "a line of text", "another line, longer than that", "x" * 40, "the quick brown fox jumps over it", "y"]
    rows = []
    for k in range(60):
        rows.append((k, "\n".join(r.choice(pool) if r.random() < 0.8 else f"own {k} {r.random()}" for _ in range(r.randrange(1, 12)))))
    rows += [(60, None), (61, ""), (62, rows[7][1]), (63, rows[7][1]), (63, rows[7][1]), (64, "\n" * 20 + "z" * 31 + "\nq"), (65, "\n" * 20 + "z" * 31 + "\nq"), (66, "no feed")]
    for least in (20, 32):
        want = brute(rows, least)
        got = L.line_dedup(docs(spark, rows), min_chars=least).select("doc_id", "text", "__lines.*", "__lines.text").collect()
        assert len(got) == len(rows)
        for row in got:
            k, x, n_lines, n_removed, n_runs, left = row[0], row[1], row[2], row[3], row[4], row[5]
            out = want.get((k, x), set())
            ls = x.split("\n") if x is not None else []
            assert (n_lines, n_removed) == (len(ls), len(out)), (k, least)
            assert n_runs == sum(1 for p in out if p - 1 not in out)
            if x is not None:
                assert left == "\n".join(v for p, v in enumerate(ls) if p not in out)


def test_null_ids_empty_tables_and_clashing_columns(spark):
    text = "a line that is long enough to count\nmore"
    d = docs(spark, [("null", text), (1, text), (2, "fresh")]).withColumnRenamed("lang", "p").withColumnRenamed("source", "name")
    got = {r.doc_id: r["__lines"].text for r in L.line_dedup(d).collect()}
    assert got == {None: text, 1: "", 2: "fresh"}
    assert L.line_dedup(empty(spark)).count() == 0


def test_short_repeated_runs_go_by_default(spark):
    rows = [(0, "All rights reserved.\n\none"), (1, "two\n\nAll rights reserved."), (2, "x\n\nthree"), (3, "four\n\nx"), (4, "five\n\n\nsix"), (5, "\n\n"), (6, "All rights reserved.\n\none")]
    want = brute(rows, 1)
    got = {r.doc_id: (r["__lines"].n_removed, r["__lines"].text) for r in L.line_dedup(docs(spark, rows)).collect()}
    assert got == {k: (len(want[k, x]), "\n".join(v for p, v in enumerate(x.split("\n")) if p not in want[k, x])) for k, x in rows}
    assert got[1] == (1, "two\n") and got[3] == (1, "four\n") and got[5][0] == 0 and got[6] == (3, "")


def lined(n, of):
    return "\n".join(f"line {k} {'again' if k % of == 0 else k * 7}" if k % of else f"again {k // of % 900}" for k in range(n))


def test_very_long_texts_take_time_in_proportion(spark):
    """100,000 lines, a third of them repeated; and four times the lines in well under sixteen times the time."""
    import time

    from pyspark.sql import functions as F

    def run(n):
        start = time.time()
        got = L.line_dedup(docs(spark, [(0, lined(n, 3)), (1, lined(n, 3))])).select("doc_id", "__lines.n_lines", "__lines.n_removed", F.length("__lines.text").alias("left")).collect()
        return time.time() - start, {r.doc_id: tuple(r)[1:] for r in got}

    run(1000)
    short, _ = run(10_000)
    long, _ = run(40_000)
    _, got = run(100_000)
    assert got == {0: (100_000, 33_334 - 900, got[0][2]), 1: (100_000, 100_000, 0)}
    assert long < 4 * short + 5


def test_ranks_are_the_order_of_windows(spark):
    rows = [(0, 0, p, w % 3, w // 3) for p, w in enumerate([5, 2, 5, 8, 2, 2, 7, 8, 0])]
    d = spark.createDataFrame(rows, "i long, k long, p int, a int, b int")
    got = {(r.a, r.b): (r["rank"], r["first"].p) for r in L._classes(d, ["a", "b"]).collect()}
    assert got == {(2, 0): (1, 1), (2, 1): (2, 0), (2, 2): (3, 3)}


def test_no_python_on_the_main_path(spark):
    plan = L.line_dedup(docs(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

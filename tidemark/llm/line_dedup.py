"""Line dedup over a suffix array of line ids, by distributed prefix doubling. DataFrame functions only.

Every document is a sequence of line ids, numbered in the order of the lines' hashes. Prefix doubling ranks,
at level k, each window of 2**k lines among all windows of that length: level k + 1 sorts the pairs of ranks
at i and i + 2**k. So each level is the suffix array to that depth, and a rank that two windows or more have is
an interval of it whose longest common prefix is 2**k lines or more. Such intervals only get a rank (dense, by
a sort over ranges, a count by range and the counts before it); lines that occur once in the corpus can be in
no repeated run, so they leave at level 0, and later levels work on what is left.

What goes: each line that lies in a run of consecutive lines of ``min_chars`` characters or more in all
which also starts at an earlier place. Such runs are covered exactly by their units: the shortest runs
from a line onwards, and up to a line, that have ``min_chars`` characters. A unit of n lines is named by
the two ranks of 2**floor(log2 n) lines that cover it; if that interval has an earlier place, its lines go.
Maximal repeated runs are unions of such units; the first copy of each stays. By default any run with a
character counts; only runs of empty lines alone stay.

Scale: lines are counted with partial sums, so a hot line is one row from each task before the shuffle;
class tables are written to the shared folder and joined back, sort-merge, where a hot class can be
split by adaptive execution. Every step is linear in a document's lines but for sorting. No group is ever
collected but the lines of one document.

Defined cases: a null text has no lines, an empty text has one, empty line; line feeds part lines and
nothing is trimmed. A text of very many lines is as many rows until the end, where it is put together again.
Rows with equal id and equal text count as one document and get equal results. Null ids come first. An empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, written

PLACE = ("i", "k", "p")


def _place() -> Column:
    return F.struct(*PLACE)


def _classes(rows: DataFrame, by: list[str], rank: str | None = "rank") -> DataFrame:
    """The intervals of two members or more, as a table: ``by``, their first place, and their rank in the
    order of ``by``."""
    found = rows.groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("__last"))
    found = found.where(F.col("first") != F.col("__last")).drop("__last")
    if rank is None:
        return written(found, "line-classes")
    ranges = written(found.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "line-ranges")
    # a row for each range, as many as there are tasks
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    out = written(ranges.withColumn("__own", own).join(F.broadcast(starts), "__range").select(*by, "first", (F.col("__start") + F.col("__own")).alias(rank)), "line-classes")
    discard(ranges)
    return out


def ordered_id(docs: DataFrame, id_col: str) -> Column:
    """The id without null, which comes first."""
    c = F.col(f"`{id_col}`")
    if dict(docs.dtypes)[id_col] == "string":
        return F.coalesce(c, F.lit(""))
    return F.coalesce(c.cast("bigint"), F.lit(-(1 << 63)))


def _units(active: DataFrame, min_chars: int) -> DataFrame:
    """i, k, p, n: the shortest runs of ``min_chars`` characters from each line on and up to each line,
    within stretches of consecutive active lines."""
    doc = Window.partitionBy("i", "k").orderBy("p")
    stretched = active.withColumn("s", F.col("p") - F.row_number().over(doc))
    stretch = Window.partitionBy("i", "k", "s")
    sums = stretched.withColumn("c", F.sum("size").over(stretch.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = sums.select("i", "k", "s", F.col("p").alias("q"), (F.col("c") - F.col("size")).alias("v")).unionByName(
        sums.groupBy("i", "k", "s").agg((F.max("p") + 1).alias("q"), F.max("c").alias("v"))
    )
    # both frames grow from row to row; one that shrinks would be summed up again for each
    up, down = (stretch.orderBy(v).rangeBetween(Window.unboundedPreceding, -min_chars) for v in (F.col("v"), -F.col("v")))
    reached = bounds.select("i", "k", "q", F.min("q").over(down).alias("end"), F.max("q").over(up).alias("start"))
    onward = reached.select("i", "k", F.col("q").alias("p"), (F.col("end") - F.col("q")).alias("n"))
    backward = reached.select("i", "k", F.col("start").alias("p"), (F.col("q") - F.col("start")).alias("n"))
    return onward.unionByName(backward).where("p IS NOT NULL AND n IS NOT NULL").dropDuplicates(["i", "k", "p", "n"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """i (id), k (key of the document), gone (numbers of its lines that go, from 0)."""
    lines = (
        docs.select(ordered_id(docs, id_col).alias("i"), document_key(id_col, text_col).alias("k"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("p", "line"))
        .select("i", "k", "p", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").cast("bigint").alias("size"))
    )
    dups = _classes(lines, ["h", "h2"])
    # a repeated row would double its places
    active = written(lines.join(dups, ["h", "h2"]).drop("h", "h2").dropDuplicates([*PLACE]), "line-level")
    unit = written(_units(active, min_chars).withColumn("level", F.floor(F.log2("n")).cast("int")), "line-units")
    top = unit.agg(F.max("level").alias("m")).collect()[0]["m"]
    level = active.select(*PLACE, "rank")
    gone = active.select(*PLACE, F.lit(1).alias("n")).limit(0)
    for at in range(0 if top is None else top + 1):
        width = 1 << at
        here = unit.where(F.col("level") == at).drop("level")
        if at == 0:
            copies = here.join(active.select(*PLACE, "first"), [*PLACE]).where(F.col("first") != _place())
        else:
            named = written(_paired(here.withColumn("p2", F.col("p") + F.col("n") - width), level), "line-units")
            by = ["n", "rank", "rank2"]
            copies = named.join(_classes(named, by, None), by).where(F.col("first") != _place())
        gone = gone.unionByName(copies.select(*PLACE, "n"))
        if at < top:
            pairs = written(_paired(level.select(*PLACE, (F.col("p") + width).alias("p2")), level), "line-pairs")
            by = ["rank", "rank2"]
            level = written(pairs.join(_classes(pairs, by, "next"), by).select(*PLACE, F.col("next").alias("rank")), "line-level")
            discard(pairs)
    places = gone.select("i", "k", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("p"))
    return places.groupBy("i", "k").agg(F.array_sort(F.collect_set("p")).alias("gone"))


def _paired(rows: DataFrame, level: DataFrame) -> DataFrame:
    """Rows with the ranks at p and at p2."""
    tail = level.select("i", "k", F.col("p").alias("p2"), F.col("rank").alias("rank2"))
    return rows.join(level, [*PLACE]).join(tail, ["i", "k", "p2"])


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "__lines", min_chars: int = 1) -> DataFrame:
    """Adds struct ``out``: n_lines, n_removed, n_runs (maximal runs of removed lines), text (what is left)."""
    gone = repeated_lines(docs, id_col, text_col, min_chars).select(F.col("i").alias(f"{out}_i"), F.col("k").alias(f"{out}_k"), F.col("gone").alias(f"{out}_g"))
    keyed = docs.withColumns({f"{out}_k": document_key(id_col, text_col), f"{out}_i": ordered_id(docs, id_col)})
    joined = keyed.join(gone, [f"{out}_i", f"{out}_k"], "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    g = F.col(f"{out}_g")
    # in proportion to the lines: numbers that stay by a difference of sets, then marks beside the lines; what a
    # lambda takes from outside would be worked out again for each line
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g)

    def marked(numbers: Column, stays: bool) -> Column:
        return F.transform(numbers, lambda k: F.struct(k.alias("k"), F.lit(stays).alias("stays")))

    marks = F.array_sort(F.concat(marked(g, False), marked(kept, True)))
    beside = F.zip_with(lines, marks, lambda x, m: F.struct(x.alias("line"), m["stays"].alias("stays")))
    rest = F.transform(F.filter(beside, lambda x: x["stays"]), lambda x: x["line"])
    left = F.when(g.isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(rest, "\n"))
    zero = F.lit(0).cast("long")
    runs = F.size(F.array_except(g, F.transform(g, lambda x: x + 1))).cast("long")
    return joined.withColumn(
        out,
        F.struct(
            F.when(F.col(f"`{text_col}`").isNull(), zero).otherwise(F.size(lines).cast("long")).alias("n_lines"),
            F.when(g.isNull(), zero).otherwise(F.size(g).cast("long")).alias("n_removed"),
            F.when(g.isNull(), zero).otherwise(runs).alias("n_runs"),
            left.alias("text"),
        ),
    ).drop(f"{out}_i", f"{out}_k", f"{out}_g")

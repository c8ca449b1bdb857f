"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's shingles are its windows of ``width`` consecutive words (an item of fewer words is
one window). Containment of a window must be whole, so its necessary prefix under the rarity order is one
token: its rarest word, by counts over all documents. Places where a document has such a token are joined
with the windows that have it as their prefix; length and positional bounds (the window must lie inside the
document, at the token's own offset) and a word-by-word comparison over the window verify the pairs.

Everything is joins of tables. What goes to the documents are two bitmaps of BITS bits over the hashes of the
benchmark's words and of its prefix tokens, whatever the benchmark's size: a place whose word is not in them
can be no candidate. A candidate brings the words around it, so documents need not move; prefix tokens are
rare, and a token of very many places is split by adaptive execution.

Defined cases: null and empty texts have no words; an item without words has no window; repeated items (equal
``item_id``) count once, different items with equal windows count each; items with a null id hit words like
others, count together as one item, and are not named. Repeated documents get equal results. Very long texts
are read whole. Empty tables: no hits. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_words, discard, give_back, holding, row_key, written

BITS = 1 << 24


def _bitmap(words: DataFrame) -> np.ndarray:
    """Of the words in column w: BITS bits over their hashes, put together where they lie."""
    at = F.pmod(F.xxhash64("w"), F.lit(BITS)) + 1
    parts = words.select(at.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():  # at most BITS / 32,768 rows of 4 KB
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


class Marked:
    """The words met so far that a bitmap may hold, remembered up to a bound."""

    def __init__(self, bitmap: np.ndarray, most: int = 400_000):
        self.bitmap, self.most, self.known, self.held = bitmap, most, set(), set()

    def __call__(self, words: list[bytes]) -> set[bytes]:
        if len(self.known) > self.most:
            self.known, self.held = set(), set()
        new = set(words).difference(self.known)
        for w in new:
            at = xxhash.xxh64_intdigest(w, seed=42) % BITS
            if self.bitmap[at >> 3] >> (at & 7) & 1:
                self.held.add(w)
        self.known |= new
        return self.held


def _windows(items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """i (the item), n, w: the windows of every item, words parted by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = ascii_words(x.as_py())
                for k in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[k : k + width]
                    out.append((i, len(part), b" ".join(part).decode()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["i", "n", "w"])

    own = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    return own.mapInArrow(run, "i string, n int, w string").distinct()


def _counts(docs: DataFrame, text: Column, bitmap: np.ndarray) -> DataFrame:
    """w, c: how often all documents have each word that the bitmap may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("decontaminate")
        marked = Marked(shared.value)
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["w", "c"])
            total.clear()
            return got

        for b in batches:
            for x in b.column(0):
                words = ascii_words(x.as_py())
                total.update(filter(marked(words).__contains__, words))
            if len(total) > 200_000:
                yield out()
        yield out()
        del marked
        give_back()

    return docs.select(text.alias("t")).mapInArrow(run, "w string, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """w, n, token, o: the windows with their rarest word and its place in them (from 0)."""
    words = windows.select("w", "n").distinct().select("w", "n", F.posexplode(F.split("w", " ")).alias("o", "token"))
    rarity = F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token", "o")
    ranked = words.join(counts.withColumnRenamed("w", "token").hint("merge"), "token", "left")
    return ranked.groupBy("w", "n").agg(F.min(rarity).alias("r")).select("w", "n", "r.token", "r.o")


def _places(docs: DataFrame, key: Column, text: Column, bitmap: np.ndarray, width: int) -> DataFrame:
    """d (the document), n_words, at: of each place whose word the bitmap may hold its number, the word, the words
    around it, and its number among these."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    ddl = "struct<n_words:bigint,at:array<struct<p:int,token:string,around:string,k:int>>>"
    place = pa.struct([("p", pa.int32()), ("token", pa.string()), ("around", pa.string()), ("k", pa.int32())])

    @F.arrow_udf(ddl)
    def find(texts: pa.Array) -> pa.Array:
        holding("decontaminate")
        marked = Marked(shared.value)
        rows = []
        for x in texts:
            words = ascii_words(x.as_py())
            at = []
            held = marked(words)
            for p in [p for p, w in enumerate(words) if w in held]:
                first = max(0, p - width + 1)
                at.append({"p": p, "token": words[p].decode(), "around": b" ".join(words[first : p + width]).decode(), "k": p - first})
            rows.append((len(words), at))
        out = pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([a for _, a in rows], pa.list_(place))], names=["n_words", "at"])
        del marked
        give_back()
        return out

    return written(docs.select(key.alias("d"), find(text).alias("f")).select("d", "f.n_words", "f.at"), "leak-places")


def found(docs: DataFrame, items: DataFrame, key: Column, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 8) -> DataFrame:
    """d (``key``), h (n_words, spans of hit words, items found): a row for every different document."""
    text = F.col(f"`{text_col}`")
    windows = written(_windows(items, item_id, item_text, width), "leak-windows")
    vocabulary = windows.select(F.explode(F.split("w", " ")).alias("w")).distinct()
    counts = written(_counts(docs, text, _bitmap(vocabulary)), "leak-counts")
    prefixes = written(_prefixes(windows, counts), "leak-prefixes")
    places = _places(docs, key, text, _bitmap(prefixes.select(F.col("token").alias("w"))), width)
    candidates = places.select("d", F.explode("at").alias("x")).select("d", "x.*").join(prefixes.hint("merge"), "token")
    words = F.split("around", " ")
    inside = (F.col("k") >= F.col("o")) & (F.col("k") - F.col("o") + F.col("n") <= F.size(words))
    equal = F.array_join(F.slice(words, F.greatest(F.col("k") - F.col("o"), F.lit(0)) + 1, F.col("n")), " ") == F.col("w")
    hits = written(candidates.where(inside).where(equal).select("d", "w", (F.col("p") - F.col("o")).alias("a"), "n").distinct(), "leak-hits")
    discard(counts, prefixes)
    named = hits.select("d", "w").distinct().join(windows.select("w", "i").hint("merge"), "w").groupBy("d").agg(F.collect_set(F.struct("i")).alias("i"))
    spans = hits.groupBy("d").agg(F.array_sort(F.collect_set(F.struct("a", (F.col("a") + F.col("n")).alias("z")))).alias("s"))
    # merged, in order: what starts within the last span makes it longer
    merge = F.expr("""aggregate(s, cast(array() as array<struct<a:int,z:int>>), (m, x) -> if(size(m) > 0 and x.a <= element_at(m, -1).z,
        concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'z', greatest(element_at(m, -1).z, x.z)))), concat(m, array(x))))""")
    flat = F.flatten(F.transform(merge, lambda x: F.array(x["a"], x["z"])))
    got = spans.join(named.hint("merge"), "d").select("d", flat.alias("spans"), F.array_sort(F.transform("i", lambda x: x["i"])).alias("items"))
    h = F.struct("n_words", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return places.select("d", "n_words").distinct().join(got.hint("merge"), "d", "left").select("d", h.alias("h"))


def hits(docs: DataFrame, items: DataFrame, text_col: str, out: str, id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", width: int = 8) -> DataFrame:
    """The documents with a struct ``out``: n_words, spans of hit words (start, end, start, end, ...), items found."""
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    got = found(docs, items, key, text_col, item_id, item_text, width).select(F.col("d").alias(f"{out}_d"), F.col("h").alias(out))
    return docs.withColumn(f"{out}_d", key).join(got.hint("merge"), f"{out}_d").drop(f"{out}_d")


def n_hit(spans: str):  # noqa: ANN201
    """Words in the spans."""
    return F.expr(f"cast(coalesce(aggregate(transform({spans}, (x, k) -> if(k % 2 = 1, x, -x)), 0, (a, x) -> a + x), 0) as bigint)")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", min_items: int = 2) -> DataFrame:
    """The documents with windows of fewer than ``min_items`` items, with their own columns only."""
    return hits(docs, items, text_col, "__hits").where(F.size("__hits.items") < min_items).select(*[F.col(f"`{c}`") for c in docs.columns])

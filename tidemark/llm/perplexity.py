"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text: documents labelled good, but for a fold of them that calibrates the
thresholds. Words are white-space tokens as they stand, hashed to CLASSES classes; so what is kept by
word are arrays of a fixed size, and only bigrams grow with the corpus. With c the count of (v, w), T the
total of context v, N1, N2, N3 its bigrams of count 1, 2 and more, and D the discounts by count,

    p(w | v) = (c - D) / T + S / T * p1(w),    S = D1 N1 + D2 N2 + D3 N3,

p1 being the like over continuation counts with a uniform rest. Hence log p(w | v) is

    log p1(w) + log(S / T)  +  log(1 + (c - D) / (S * p1(w))) if the bigram is known.

The first two are array lookups where the document lies; the third is a join of bigrams with counts,
sharded by context: packed keys of documents meet the sorted counts of their shard, which answers with
one sum for each document. Shards are worked off in ``passes``, so no more than a part of the corpus's
bigrams is on disk at a time.

A document is kept if its perplexity is at most the ``quantile`` of its language's calibration documents
(all calibration documents, for a language that has none; without any, everything with words is kept).

Defined cases: null and empty texts have no words, perplexity null, and are not kept; rows equal in id
and text have equal scores; a null language is a language of its own; labels of unknown ids are ignored.
Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, encoded, written
from tidemark.llm.jaccard_join import whole_groups

BITS = 22
CLASSES = 1 << BITS
BEGIN, END = 0, 1
MASK = np.uint64(CLASSES - 1)
RANGES = 64


class Classes:
    """Word classes, remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = 2 + xxhash.xxh3_64_intdigest(w) % (CLASSES - 2)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_classes = Classes()


def sequence(text: str | None) -> np.ndarray:
    """Begin, the classes of the words, end; nothing for a text without words."""
    words = encoded(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.concatenate([[np.uint64(BEGIN)], _classes(words), [np.uint64(END)]])


def bigrams(s: np.ndarray) -> np.ndarray:
    return (s[:-1] << np.uint64(BITS)) | s[1:]


def discounts(n: np.ndarray) -> np.ndarray:
    """D by count (0, 1, 2, 3 or more) from how many things have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    # few counts can push an estimate out of its range
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])


@dataclass(frozen=True)
class Model:
    """discount: of bigrams. rest: S by context. unigram: p1 by class. local: log p1 + log(S / T) by class."""

    discount: np.ndarray
    rest: np.ndarray
    unigram: np.ndarray
    local: np.ndarray

    def ends(self) -> float:
        """What the first context and the last prediction bring to any sequence."""
        return float(np.log(self.unigram[END]) + self.local[BEGIN] - np.log(self.unigram[BEGIN]))

    def gain(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        return gains(self.discount, self.unigram, self.rest[(key >> np.uint64(BITS)).astype(np.int64)], key, count)


def gains(discount: np.ndarray, unigram: np.ndarray, rest: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What known bigrams add to a log probability; ``rest``: S of their contexts."""
    return np.log1p((count - discount[np.minimum(count, 3)]) / (rest * unigram[(key & MASK).astype(np.int64)]))


def rests(discount: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """S of each bigram's context, of sorted bigrams that hold whole contexts."""
    v = key >> np.uint64(BITS)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    total = np.add.reduceat(discount[np.minimum(count, 3)], first)
    return np.repeat(total, np.diff(np.append(first, len(v))))


def model_of(contexts: list[np.ndarray], continuations: np.ndarray, counts: np.ndarray) -> Model:
    """contexts: T, N1, N2, N3 by class; continuations: by class; counts: bigrams of count 1 to 4."""
    d = discounts(counts)
    rest = np.zeros(CLASSES, np.float32)
    for by, n in zip(d[1:], contexts[1:], strict=True):
        rest += np.float32(by) * n
    seen = contexts[0] > 0
    k = continuations
    dk = discounts(np.array([(k == j).sum() for j in (1, 2, 3, 4)]))
    every = max(int(k.sum(dtype=np.int64)), 1)
    uniform = (dk[1] * (k == 1).sum() + dk[2] * (k == 2).sum() + dk[3] * (k >= 3).sum()) / every / CLASSES if k.any() else 1 / CLASSES
    unigram = (np.maximum(k - dk.astype(np.float32)[np.minimum(k, 3)], 0) / np.float32(every)).astype(np.float32) + np.float32(uniform)
    local = np.log(unigram)
    local[seen] += np.log(rest[seen] / contexts[0][seen].astype(np.float32))
    rest[~seen] = 1
    return Model(d, rest, unigram, local)


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def packed(key: np.ndarray) -> bytes:
    """Keys of 44 bits in 6 bytes: low halves, then high ones, which compress where keys are sorted."""
    return (key & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (key >> np.uint64(32)).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _shard_bits(spark) -> int:  # noqa: ANN001
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4, min(BITS, (partitions - 1).bit_length() - 1))


def train(trusted: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model's arrays, and its bigrams: shard, keys, counts."""
    spark = trusted.sparkSession
    bits = _shard_bits(spark)
    down = np.uint64(2 * BITS - bits)
    pieces = [("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [bigrams(s) for x in b.column(0) if len(s := sequence(x.as_py()))]
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                shard = (key >> down).astype(np.int64)
                yield _batch(pieces, [(int(shard[x]), packed(key[x:y]), n[x:y].astype("<u4").tobytes()) for x, y in _cuts(shard)])

    table = [("kind", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard"):
            shard = t.column("shard").to_numpy()
            for x, y in _cuts(shard):
                key = np.concatenate([unpacked(t.column("keys")[k].as_py()) for k in range(x, y)])
                n = np.concatenate([np.frombuffer(t.column("counts")[k].as_py(), "<u4") for k in range(x, y)]).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, n = key[head], np.add.reduceat(n, head)
                v = (key >> np.uint64(BITS)).astype("<u4")
                first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                stats = [v[first], *(np.add.reduceat(z.astype("<u4"), first) for z in (n, n == 1, n == 2, n >= 3))]
                counts = np.array([(n == j).sum() for j in (1, 2, 3, 4)], "<u8")
                more = counts.tobytes() + np.stack(stats).astype("<u4").tobytes()
                rows = [(0, int(shard[x]), packed(key), n.astype("<u4").tobytes(), more)]
                w, k = np.unique((key & MASK).astype(np.int64), return_counts=True)
                part = w * RANGES >> BITS
                rows += [(1, int(part[a]), w[a:z].astype("<u4").tobytes(), k[a:z].astype("<u4").tobytes(), None) for a, z in _cuts(part)]
                yield _batch(table, rows)

    counted = trusted.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "shard bigint, keys binary, counts binary")
    ddl = "kind int, shard bigint, keys binary, counts binary, more binary"
    merged = written(counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, ddl), "perplexity-bigrams")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard"):
            shard = t.column("shard").to_numpy()
            for x, y in _cuts(shard):
                total = np.zeros(CLASSES // RANGES, np.int64)
                for k in range(x, y):
                    w = np.frombuffer(t.column("keys")[k].as_py(), "<u4").astype(np.int64) - int(shard[x]) * (CLASSES // RANGES)
                    total[w] += np.frombuffer(t.column("counts")[k].as_py(), "<u4")
                yield _batch([("shard", pa.int64()), ("k", pa.binary())], [(int(shard[x]), total.astype("<u4").tobytes())])

    # arrays of CLASSES numbers, whatever the corpus
    continuations = np.zeros(CLASSES, np.uint32)
    sums = merged.where("kind = 1").select("shard", "keys", "counts").repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "shard bigint, k binary")
    for r in sums.collect():
        at = r["shard"] * (CLASSES // RANGES)
        continuations[at : at + CLASSES // RANGES] = np.frombuffer(r["k"], "<u4")
    contexts, counts = [np.zeros(CLASSES, t) for t in (np.uint64, np.uint32, np.uint32, np.uint32)], np.zeros(4, np.int64)
    for r in merged.where("kind = 0").select("more").toLocalIterator():
        counts += np.frombuffer(r["more"], "<u8", 4).astype(np.int64)
        stats = np.frombuffer(r["more"], "<u4", -1, 32).reshape(5, -1)
        for own, part in zip(contexts, stats[1:], strict=True):
            own[stats[0]] = part
    return model_of(contexts, continuations, counts), merged.where("kind = 0").select("shard", "keys", "counts")


def log_likelihoods(rows: DataFrame, model: Model, known: DataFrame, passes: int = 2) -> DataFrame:
    """rk, rk2, gain: what known bigrams add, by document key (two hashes). ``rows``: rk, rk2, t."""
    spark = rows.sparkSession
    bits = _shard_bits(spark)
    down = np.uint64(2 * BITS - bits)
    # one array of CLASSES numbers; S comes from a shard's own bigrams, which hold whole contexts
    shared = spark.sparkContext.broadcast((model.discount, model.unigram))
    passes = min(passes, 1 << bits)

    def ask(number: int):  # noqa: ANN202
        low, high = (number << bits) // passes, ((number + 1) << bits) // passes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rk = np.stack([b.column("rk").to_numpy(), b.column("rk2").to_numpy()], axis=1)
                seqs = [sequence(x.as_py()) for x in b.column("t")]
                keys = [bigrams(s) if len(s) else s for s in seqs]
                if not any(map(len, keys)):
                    continue
                key = np.concatenate(keys)
                row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                shard = (key >> down).astype(np.int64)
                own = (shard >= low) & (shard < high)
                key, row, shard = key[own], row[own], shard[own]
                order = np.argsort(shard, kind="stable")  # rows stay in order within a shard
                key, row, shard = key[order], row[order], shard[order]
                out = []
                for x, y in _cuts(shard):
                    r, n = np.unique(row[x:y], return_counts=True)
                    out.append((int(shard[x]), 1, packed(key[x:y]), np.uint32(len(r)).tobytes() + rk[r].astype("<i8").tobytes() + n.astype("<u4").tobytes()))
                yield _batch([("shard", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())], out)

        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        discount, unigram = shared.value
        at, table, counts, rest = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            for k in range(b.num_rows):
                shard, kind = b.column("shard")[k].as_py(), b.column("kind")[k].as_py()
                key, extra = unpacked(b.column("keys")[k].as_py()), b.column("counts")[k].as_py()
                if kind == 0:
                    at, table, counts = shard, key, np.frombuffer(extra, "<u4").astype(np.int64)
                    rest = rests(discount, table, counts)
                    continue
                if shard != at or not len(table):
                    continue
                n = int(np.frombuffer(extra, "<u4", 1)[0])
                rk, sizes = np.frombuffer(extra, "<i8", 2 * n, 4).reshape(n, 2), np.frombuffer(extra, "<u4", n, 4 + 16 * n)
                where = np.minimum(np.searchsorted(table, key), len(table) - 1)
                gain = np.where(table[where] == key, gains(discount, unigram, rest[where], key, counts[where]), 0.0)
                sums = np.add.reduceat(gain, np.cumsum(np.append(0, sizes[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(rk[:, 0].copy()), pa.array(rk[:, 1].copy()), pa.array(sums)], ["rk", "rk2", "gain"])

    parts = None
    for number in range(passes):
        low, high = (number << bits) // passes, ((number + 1) << bits) // passes
        asked = rows.select("rk", "rk2", "t").mapInArrow(ask(number), "shard bigint, kind int, keys binary, counts binary")
        mine = known.where((F.col("shard") >= low) & (F.col("shard") < high)).select("shard", F.lit(0).alias("kind"), "keys", "counts")
        answered = mine.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "rk bigint, rk2 bigint, gain double")
        part = written(answered.groupBy("rk", "rk2").agg(F.sum("gain").alias("gain")), "perplexity-gains")
        parts = part if parts is None else parts.unionByName(part)
    shared.destroy()
    return parts.groupBy("rk", "rk2").agg(F.sum("gain").alias("gain"))


def perplexities(docs: DataFrame, labels: DataFrame, text_col: str = "text", out: str = "__lm", quantile: float = 0.995, folds: int = 5, passes: int = 2) -> DataFrame:
    """Adds struct ``out``: n_words, perplexity, threshold (of the language) and kept."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held: Column = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    trusted = written(docs.select("doc_id", text.alias("t")).join(good.where(~held).hint("merge"), "doc_id").select("t"), "perplexity-trusted")
    model, known = train(trusted, "t")
    discard(trusted)
    key = [f"{out}_rk", f"{out}_rk2"]
    keyed = docs.withColumns({key[0]: F.xxhash64("doc_id", text), key[1]: F.xxhash64(F.lit(1), "doc_id", text)})
    both = [F.col(key[0]).alias("rk"), F.col(key[1]).alias("rk2")]
    # rows that are equal would add their bigrams twice: their sums are divided by their number
    gains = log_likelihoods(keyed.select(*both, text.alias("t")), model, known, passes)
    ends, shared = model.ends(), spark.sparkContext.broadcast(model.local)

    def local(column: pa.Array) -> pa.Array:
        """Words, and what a sequence has without known bigrams."""
        values = shared.value
        inner = [sequence(x.as_py())[1:-1].astype(np.int64) for x in column]
        ll = [float(values[s].sum(dtype=np.float64)) + ends if len(s) else None for s in inner]
        return pa.StructArray.from_arrays([pa.array([len(s) for s in inner], pa.int64()), pa.array(ll, pa.float64())], names=["n", "ll"])

    own = keyed.select("doc_id", "lang", *both, F.arrow_udf(local, "struct<n:bigint,ll:double>")(text).alias("b"))
    own = own.groupBy("rk", "rk2").agg(F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), F.first("b").alias("b"), F.count(F.lit(1)).alias("rows"))
    nats = F.col("b.ll") + F.coalesce("gain", F.lit(0.0)) / F.col("rows")
    scored = written(own.join(gains.hint("merge"), ["rk", "rk2"], "left").select("rk", "rk2", "doc_id", "lang", F.col("b.n").alias("n"), F.exp(-nats / (F.col("b.n") + 1)).alias("ppl")), "perplexity-scored")
    calibration = scored.where(held & F.col("ppl").isNotNull()).join(good, "doc_id")
    # a row for each language
    by_lang = calibration.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("ppl", quantile, 10_000).alias("q"))
    overall = calibration.agg(F.percentile_approx("ppl", quantile, 10_000).alias("q")).first()["q"]
    limit = F.coalesce("q", F.lit(overall).cast("double"))
    judged = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        F.col("rk").alias(key[0]), F.col("rk2").alias(key[1]),
        F.struct(F.col("n").alias("n_words"), F.col("ppl").alias("perplexity"), limit.alias("threshold"), F.coalesce(F.col("ppl") <= limit, F.col("ppl").isNotNull()).alias("kept")).alias(out),
    )
    return keyed.join(judged.hint("merge"), key).drop(*key)

"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

1.  A text is the set of its shingles (five consecutive words; a text of fewer words is one shingle).
    Texts with equal sets form a class; one of each class goes on, so copies cost nothing more.
2.  A class has a label of DEPTH minima in each of TREES trees. A tree is the prefix trie of its labels; it is
    kept sorted, as a table dealt by ranges of (node at the least depth, label, class), so that the members of
    a node are a run of rows and a large node spans several tasks. Classes that share no node of the least
    depth with another are in no table.
3.  The walk starts at whole labels, where each class is compared, by one bit of every minimum, with the first
    of its node; pairs within ``margin`` of the threshold connect. Then, at each depth from there on, nodes
    that hold classes not yet known to be connected have all pairs across their components compared: those
    outside the largest component meet all others. The prefix is shortened by one, for those only whose
    node still holds classes that they are not connected with, down to the depth at which the chance that
    a pair at the threshold meets in some tree reaches the target recall (``prefix_for``). A cluster of near
    copies is so put together by its first members, and costs nothing in the shallow, wide nodes. Counts of
    members are partial sums; both sides of a node are dealt into blocks, and block meets block.
4.  Components of these edges hold all pairs that can be links. Their texts come back once, as sets; each is
    written down as its difference from the component's pivot (its least class), which is short for near
    copies, and all intersections follow from those differences and their sizes, by matrix products in the
    same kind of blocks. Pairs are never rows.
5.  Verified links give the number of links of each class, and components of links the groups.

Joins with what grows with the corpus are sort-merge joins at every size, whose large keys adaptive
execution can split. Work on one cluster of m near copies with different texts grows with m * m, as its
links do, in blocks that any number of tasks share; rows grow with m to the power of 1.5.

Loss: a pair at exactly the threshold is missed with a chance of some 1e-5 (7e-6 by the forest, 2e-6 by the
bits' margin); at a similarity of 0.85 both are below 1e-8. No cap is set on partners or nodes.

Defined cases: null texts and texts without words have no links; each is its own group, and its class is
null. Rows that are equal count as copies. A null id stands after all others. Very long texts are sets like
others; blocks are also bounded by their shingles. Empty tables give empty results. ``jaccard_groups`` returns
its own columns only; ``one_of_each`` returns those of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_words, discard, give_back, holding, row_key, written
from tidemark.llm.components import components
from tidemark.llm.license_scan import Hashes, grams

TREES, DEPTH = 30, 8
#: A level of a label is the top 16 bits of its minimum.
LEVEL = 2
#: Members of a block: four times the root of the group's size, within these bounds.
BLOCK, LARGEST_BLOCK = 64, 2048
BLOCK_SHINGLES = 1_500_000
_r = np.random.default_rng(20240607)
_MUL = (_r.integers(1, 1 << 63, TREES * DEPTH, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _r.integers(0, 1 << 63, TREES * DEPTH, dtype=np.int64).astype(np.uint64)
_hashes = Hashes()


def prefix_for(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with this chance."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("more trees are needed for this recall")


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(grams(words, min(width, len(words)), _hashes))


def forget() -> None:
    _hashes.known.clear()


def class_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    u = s.view(np.uint64)
    v = u * np.uint64(0x9FB21C651E98DF25)
    v ^= v >> np.uint64(35)
    return int((u * (v | np.uint64(1))).sum(dtype=np.uint64)).to_bytes(8, "big") + int((v * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) ^ np.uint64(len(u))).to_bytes(8, "big")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima [set][function]; sets must not be empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 100_000):
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end]).view(np.uint64)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        buffer = np.empty_like(h)
        for j in range(TREES * DEPTH):
            np.multiply(h, _MUL[j], out=buffer)
            np.add(buffer, _ADD[j], out=buffer)
            out[at:end, j] = np.minimum.reduceat(buffer, starts)
        at = end
    return out


def labels_and_bits(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: the labels of all trees, LEVEL bytes for each minimum, and a bit of every minimum."""
    labels = (minima >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(len(minima), LEVEL * TREES * DEPTH)
    bits = np.packbits((minima >> np.uint64(40)).astype(np.uint8) & 1, axis=1)
    return labels, np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))


def _signed(docs: DataFrame, identity: Column, text: Column, width: int) -> DataFrame:
    """id, rk (key of the row), c (class; null: no words), n (shingles), labels, bits of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard join", forget)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                sets = [shingles(x.as_py(), width) for x in rows.column("t")]
                full = [k for k, s in enumerate(sets) if len(s)]
                labels, bits = labels_and_bits(signatures([sets[k] for k in full]) if full else np.zeros((0, TREES * DEPTH), np.uint64))
                where = {k: j for j, k in enumerate(full)}
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), rows.column("rk"),
                        pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        *(pa.array([of[where[k]].tobytes() if k in where else None for k in range(len(sets))], pa.binary()) for of in (labels, bits)),
                    ],
                    ["id", "rk", "c", "n", "labels", "bits"],
                )
        give_back()

    id_type = docs.select(identity.alias("id")).schema[0].dataType.simpleString()
    return docs.select(identity.alias("id"), row_key(identity, text).alias("rk"), text.alias("t")).mapInArrow(
        run, f"id {id_type}, rk binary, c binary, n int, labels binary, bits binary"
    )


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of the keys they have; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Union:
    """Connected components of a few thousand vertices, fed a vertex's neighbours at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, v: int, others: np.ndarray) -> None:
        met = np.unique(self.label[others])
        own = self.label[v]
        if len(met) > 1 or (len(met) and met[0] != own):
            self.label[np.isin(self.label, np.append(met, own))] = min(int(met[0]), int(own))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _packed(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _near_first(most: int):  # noqa: ANN202
    """Edges (a, b) between members and the first of their node, with ``most`` unequal bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard walk")
        for batch in batches:
            near = np.bitwise_count(_packed(batch.column("bits")) ^ _packed(batch.column("first_bits"))).sum(axis=1) <= most
            yield batch.select(["c", "first"]).filter(pa.array(near)).rename_columns(["a", "b"])

    return run


def _near_edges(most: int):  # noqa: ANN202
    """Edges (a, b) between members of a node, of different components, with ``most`` unequal bits or fewer;
    ``asks`` marks the rows that are compared with the others of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard walk")
        for table in whole_groups(batches, "g"):
            g, asks = table.column("g").to_numpy(), table.column("asks").to_numpy()
            comp, c = _codes(table.column("comp")), table.column("c").to_pylist()
            bits = _packed(table.column("bits"))
            a, b = [], []
            for start, end in _bounds(g):
                x, own, asked = bits[start:end], comp[start:end], asks[start:end]
                groups = Union(end - start)
                for k in np.flatnonzero(asked).tolist():
                    near = np.bitwise_count(x ^ x[k]).sum(axis=1) <= most
                    near &= ~asked & (own != own[k])
                    if near.any():
                        groups.join(k, np.flatnonzero(near))
                for v in np.flatnonzero(groups.label != np.arange(end - start)).tolist():
                    a.append(c[start + v])
                    b.append(c[start + int(groups.label[v])])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        give_back()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each pair of sets has in common."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(head) - 1
    shared = (np.bincount(column) >= 2)[column] if len(flat) else head
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    total = int(column[-1]) + 1 if len(column) else 0
    step = 4096
    for at in range(0, total, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        rows = np.unique(owner[lo:hi])
        x = np.zeros((len(rows), min(step, total - at)), np.float32)
        x[np.searchsorted(rows, owner[lo:hi]), column[lo:hi] - at] = 1
        out[np.ix_(rows, rows)] += x @ x.T
    return out


def _links(numerator: int, denominator: int):  # noqa: ANN202
    """c, links, root of every class in a group: verified pairs counted, never emitted. A class comes as the
    shingles ``d`` in which it and its pivot differ, ``lost`` of them the pivot's; of two, the pivot's
    shingles less what either lost, and what they differ in alike, are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard links")
        for table in whole_groups(batches, "g"):
            # a row that comes twice brings its class twice
            first = np.unique(np.stack([table.column("g").to_numpy(), _codes(table.column("c"))], axis=1), axis=0, return_index=True)[1]
            table = table.take(pa.array(np.sort(first)))
            g = table.column("g").to_numpy()
            blk, across = table.column("blk").to_numpy(), table.column("across").to_numpy()
            comp, c = _codes(table.column("comp")), table.column("c").to_pylist()
            n, pivot, lost = (table.column(x).to_numpy().astype(np.int64) for x in ("n", "pivot", "lost"))
            flat = table.column("d").combine_chunks()
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            got, links, root_of = [], [], []
            for start, end in _bounds(g):
                of = slice(start, end)
                alike = overlaps([values[ends[k] : ends[k + 1]] for k in range(start, end)])
                side, own, size = blk[of], comp[of], n[of]
                groups, count = Union(end - start), np.zeros(end - start, np.int64)
                for k in range(end - start):
                    common = np.rint(alike[k]).astype(np.int64) + pivot[start + k] - lost[start + k] - lost[of]
                    # common / (a + b - common) >= numerator / denominator
                    near = common * (numerator + denominator) >= numerator * (size[k] + size)
                    near &= own == own[k]  # two components may stand under one key
                    near[k] = False
                    if across[start + k]:  # one of the two blocks may be empty
                        near &= side != side[k]
                    count[k] = near.sum()
                    if count[k]:
                        groups.join(k, np.flatnonzero(near))
                got += c[of]
                links += count.tolist()
                root_of += [c[start + int(k)] for k in groups.label]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(links, pa.int64()), pa.array(root_of, pa.binary())], ["c", "links", "root"])
        give_back()

    return run


def _blocks(n: str) -> str:
    """How many blocks a group of n members makes."""
    return f"ceil({n} / least({LARGEST_BLOCK}, greatest({BLOCK}, 4 * sqrt({n}))))"


def _dealt(rows: DataFrame, blocks: str, *key: str) -> DataFrame:
    """Each row once for every block that its own block meets, with g for the pair of blocks, and across
    where the pair's blocks differ; dealt by g, and sorted."""
    return (
        rows.withColumn("blk", F.expr(f"cast(pmod(xxhash64(c, 5), {blocks}) as int)"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
        .withColumn("g", F.xxhash64(*key, F.least("blk", "other"), F.greatest("blk", "other")))
        .withColumn("across", F.expr("other <> blk"))
        .drop("other", blocks, *[k for k in key if k != "comp"])
        .repartition("g")
        .sortWithinPartitions("g")
    )


def _tries(reps: DataFrame, least: int) -> DataFrame:
    """The trees below their nodes of the least depth that hold two classes or more: root (the node), label,
    c, bits; sorted."""
    label = f"substring(labels, cast(t * {LEVEL * DEPTH} + 1 as int), {LEVEL * DEPTH})"
    nodes = reps.select("c", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"), "labels", "bits").select(
        F.expr(f"xxhash64(t, substring({label}, 1, {LEVEL * least}))").alias("root"), F.expr(label).alias("label"), "c", "bits"
    )
    full = written(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("root"), "jaccard-nodes")
    tries = written(nodes.join(full.hint("merge"), "root").repartitionByRange("root", "label", "c").sortWithinPartitions("root", "label", "c"), "jaccard-tries")
    discard(full)
    return tries


def _at(tries: DataFrame, depth: int) -> DataFrame:
    """The members with their node at this depth: root and prefix."""
    return tries.withColumn("prefix", F.expr(f"substring(label, 1, {LEVEL * depth})")).drop("label")


def _walk(tries: DataFrame, least: int, most: int) -> DataFrame:
    """v, root: components of what the walk connects."""
    own, node = _at(tries, DEPTH), ["root", "prefix"]
    firsts = written(own.groupBy(*node).agg(F.min(F.struct("c", "bits")).alias("f"), F.count(F.lit(1)).alias("m")).where("m > 1").select(*node, F.col("f.c").alias("first"), F.col("f.bits").alias("first_bits")), "jaccard-firsts")
    edges = own.join(firsts.hint("merge"), node).where("c <> first").select("c", "bits", "first", "first_bits").mapInArrow(_near_first(most), "a binary, b binary")
    found = written(components(edges), "jaccard-walk")
    discard(firsts)
    for depth in range(DEPTH, least - 1, -1):
        named = found.select(F.col("v").alias("c"), F.col("root").alias("comp")).hint("merge")
        own = written(_at(tries, depth).join(named, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "jaccard-members")
        parts = own.groupBy(*node, "comp").agg(F.count(F.lit(1)).alias("m"))
        sizes = parts.groupBy(*node).agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        blocks = [F.expr(f"cast({_blocks(n)} as int)").alias(name) for n, name in (("m", "nb"), ("(m - top.m)", "na"))]
        mixed = written(sizes.select(*node, F.col("top.comp").alias("most"), *blocks), "jaccard-mixed")
        if mixed.take(1):
            rows = own.join(mixed.hint("merge"), node).withColumn("of", F.xxhash64(F.lit(5), "c"))
            # those outside the largest component meet each block of all; all meet each block of those
            dealt = F.expr("""explode(concat(
                if(comp <> most, transform(sequence(0, nb - 1), y -> struct(cast(pmod(of, na) as int) AS x, y AS y, true AS asks)), array()),
                transform(sequence(0, na - 1), x -> struct(x AS x, cast(pmod(of, nb) as int) AS y, false AS asks))))""")
            dealt = rows.select(*node, "comp", "c", "bits", dealt.alias("p")).select(F.xxhash64(*node, "p.x", "p.y").alias("g"), "p.asks", "comp", "c", "bits")
            edges = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_near_edges(most), "a binary, b binary")
            new = written(components(edges.unionByName(found.select(F.col("v").alias("a"), F.col("root").alias("b")))), "jaccard-walk")
            discard(found)
            found = new
        discard(own, mixed)
    return found


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5), width: int = 5, recall: float = 0.99999, margin: float = 0.2) -> DataFrame:
    """A row for every document: id, rk (key of id and text), c (class), class_id (least id among equal
    sets), n_links (classes linked with its own), group_id (least id among all that links connect), and
    group_rk (the key of the row that stands first in the group)."""
    level = threshold[0] / threshold[1]
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    signed = written(_signed(docs, identity, text, width), "jaccard-signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "rk"))
    reps = written(
        signed.where("c IS NOT NULL").groupBy("c").agg(first.alias("f"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("bits").alias("bits")),
        "jaccard-classes",
    )
    least = prefix_for(level, recall)
    tries = _tries(reps, least)
    comps = _walk(tries, least, int((1 - level + margin) * TREES * DEPTH / 2)).select(F.col("v").alias("c"), F.col("root").alias("comp"))
    discard(tries)

    picked = comps.join(reps.select("c", F.col("f.rk").alias("rk"), "n").hint("merge"), "c")
    sizes = picked.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).select("comp", F.expr(f"cast(greatest({_blocks('m')}, ceil(n / {BLOCK_SHINGLES})) as int)").alias("nb"))
    picked = written(picked.join(written(sizes, "jaccard-sizes").hint("merge"), "comp").select("rk", "c", "comp", "nb"), "jaccard-picked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard join", forget)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = [shingles(x.as_py(), width) for x in part.column("t")]
                right = [k for k, (s, c) in enumerate(zip(found, part.column("c").to_pylist(), strict=True)) if len(s) and class_key(s) == c]
                ends = np.cumsum([0, *(len(found[k]) for k in right)], dtype=np.int32)
                flat = np.concatenate([found[k] for k in right]) if right else np.zeros(0, np.int64)
                kept = part.take(pa.array(right, pa.int32()))
                yield pa.RecordBatch.from_arrays([kept.column("c"), kept.column("comp"), kept.column("nb"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["c", "comp", "nb", "s"])
        give_back()

    texts = docs.select(row_key(identity, text).alias("rk"), text.alias("t")).join(picked.hint("merge"), "rk")
    payload = written(texts.mapInArrow(sets, "c binary, comp binary, nb int, s array<bigint>"), "jaccard-sets")
    # the least class of a component names it: its pivot; a row that comes twice would double its component
    pivots = written(payload.where("c = comp").groupBy("comp").agg(F.first("s").alias("p")), "jaccard-pivots")
    lost = F.array_except("p", "s")
    apart = payload.join(pivots.hint("merge"), "comp").select(
        "comp", "c", "nb", F.size("s").alias("n"), F.size("p").alias("pivot"), F.size(lost).alias("lost"), F.concat(lost, F.array_except("s", "p")).alias("d")
    )
    verified = written(
        _dealt(apart, "nb", "comp").select("g", "blk", "across", "comp", "c", "n", "pivot", "lost", "d").mapInArrow(_links(*threshold), "c binary, links bigint, root binary"),
        "jaccard-links",
    )
    discard(payload, picked, pivots)
    links = verified.groupBy("c").agg(F.sum("links").alias("n_links"))
    groups = components(verified.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("c"), F.col("root").alias("grp"))
    classes = written(reps.select("c", "f").join(links.hint("merge"), "c", "left").join(groups.hint("merge"), "c", "left").withColumn("grp", F.coalesce("grp", "c")), "jaccard-classes")
    discard(verified, reps)
    heads = written(classes.groupBy("grp").agg(F.min("f").alias("h")), "jaccard-heads")
    known = written(
        classes.join(heads.hint("merge"), "grp").select("c", F.col("f.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("h.id").alias("group_id"), F.col("h.rk").alias("group_rk")),
        "jaccard-known",
    )
    discard(classes, heads)
    own = signed.select("id", "rk", "c")
    worded = own.where("c IS NOT NULL").join(known.hint("merge"), "c").select("id", "rk", "c", "class_id", "n_links", "group_id", "group_rk")
    wordless = own.where("c IS NULL").select("id", "rk", "c", F.lit(None).cast(own.schema["id"].dataType).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"), F.col("rk").alias("group_rk"))
    return worded.unionByName(wordless)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The first document (by id) of every group, with its own columns only; all documents without words
    stay, repeated ones too."""
    found = jaccard_groups(docs, id_col, text_col, threshold).where("rk = group_rk")
    rows = written(found.groupBy("rk").agg(F.count(F.lit(1)).alias("__copies"), F.max(F.col("c").isNull()).alias("__wordless")), "jaccard-first")
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.withColumn("__rk", row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).join(rows.withColumnRenamed("rk", "__rk").hint("merge"), "__rk")
    once = F.expr("__copies = 1 OR __wordless")
    return kept.where(once).select(*own).unionByName(kept.where(~once).dropDuplicates(["__rk"]).select(*own))

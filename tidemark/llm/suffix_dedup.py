"""Exact substring dedup: bytes covered by a WINDOW-byte string that also starts in a document with a
smaller id are removed.

Suffix arrays of all text would have to meet pairwise; so the corpus is first thinned without loss.

1.  Anchors. Of the SEED-byte strings in each window the one with the least hash is the window's anchor;
    equal windows have equal anchors at equal offsets. About one position in sixteen is an anchor. Anchor
    keys go to key shards as packed arrays, a key once from each batch of documents (what a batch has in
    two documents is known there already), so a key of very many documents is as many entries as batches.
2.  Documents learn which of their anchors others have too. Windows of other anchors occur nowhere else.
    Documents without shared anchors are finished here.
3.  Per-shard suffix arrays. The stretches around shared anchors, SHARD_BYTES at a time, are sorted by
    Larsson-Sadakane refinement (ranks of 8, 16, 32, 64 bytes; only unsorted groups are sorted again);
    Kasai's pass, run in lockstep over strips, gives common prefixes; runs with WINDOW bytes in common are
    equal windows. Within a shard later documents lose theirs; the first keeps one copy, which is exported.
4.  Cross-shard merging. Exported windows meet by anchor key; their 64-bit hashes are sorted once and each
    window finds its equals by binary search, bytes are then compared, and the smallest id is the keeper.
5.  Windows to remove return to their documents, in one join by id and a hash of id and text.

Every group is packed arrays in one task: a shard's share of keys grows with the number of batches over shards,
and an anchor that all sorting shards have brings one run of windows from each. Nothing but counts goes to
the driver.

Defined cases: a null text is empty; a null id is smaller than all others; rows with equal id do not
remove from each other; texts shorter than a window are kept whole; very long texts are read in
overlapping pieces. Empty tables give empty results. The result has its own columns only, whatever those of the
input are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, encoded, written
from tidemark.llm.jaccard_join import whole_groups

WINDOW, SEED = 50, 20
SEEDS = WINDOW - SEED + 1
CHUNK = 1 << 17
SLICE_BYTES = 4 << 20
SHARD_BYTES = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Hashes of all substrings of one length, from prefix sums modulo 2**64."""

    def __init__(self, size: int = CHUNK + 2 * WINDOW):
        self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        if n < width:
            return np.zeros(0, U)
        if n > len(self.up):
            self.__init__(2 * n)
        sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.down[:n], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.up[: n - width + 1]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        return h


_roll = Roller()


def argmin_leftmost(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its first minimum."""
    m, at, have = v, np.arange(len(v), dtype=np.int32), 1
    while have < width:
        h = min(have, width - have)
        a, b = m[:-h], m[h:]
        right = b < a
        at = np.where(right, at[h:], at[:-h])
        m = np.where(right, b, a)
        have += h
    return at


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that lie one after another in ``data`` and end at ``ends``: anchor key, first and last
    window start, for each run of windows with one anchor."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = _roll(data, SEED)
    at = argmin_leftmost(v, SEEDS)[:n]
    good = np.ones(n, bool)
    for e in ends[:-1].tolist():
        good[max(0, e - WINDOW + 1) : e] = False
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= ~good[:-1]
    new &= good
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a run ends before the next one, or at its document's last window
    last = np.append(first[1:] - 1, n - 1)
    limit = ends[np.searchsorted(ends, first, side="right")] - WINDOW
    # least hashes are small numbers: mixed again, keys spread over all shards
    key = v[at[first]] * U(0x9E3779B97F4A7C15)
    key ^= key >> U(32)
    key *= U(0xD6E8FEB86659FD93)
    return key ^ (key >> U(29)), first.astype(np.int64), np.minimum(last, limit).astype(np.int64)


def doc_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, first and last window start of every run of windows, in order."""
    rows, keys, firsts, lasts = [], [], [], []
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        if part:
            lengths = np.array([len(x) for _, _, x in part], np.int64)
            ends = np.cumsum(lengths)
            k, a, b = anchors(np.frombuffer(b"".join(x for _, _, x in part), np.uint8), ends)
            owner = np.searchsorted(ends, a, side="right")
            shift = np.array([base for _, base, _ in part], np.int64)[owner] - (ends - lengths)[owner]
            rows.append(np.array([r for r, _, _ in part], np.int64)[owner])
            keys.append(k)
            firsts.append(a + shift)
            lasts.append(b + shift)
        part, size = [], 0

    for r, x in enumerate(texts):
        for base in range(0, max(1, len(x) - WINDOW + 1), CHUNK):
            piece = x[base : base + CHUNK + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            if part and size + len(piece) > CHUNK:
                flush()
            part.append((r, base, piece))
            size += len(piece)
    flush()
    if not rows:
        return tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64))
    return tuple(map(np.concatenate, (rows, keys, firsts, lasts)))


def words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros following the end: a view, no copy of its own."""
    raw = data.tobytes() + bytes(WINDOW + 24)
    return np.ndarray((len(data) + WINDOW + 16,), f"{order}u8", raw, strides=(1,))


def suffix_array(data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes or more, and each one's slot in it."""
    n = len(data)
    s = words_at(data, ">")[:n].astype(U)
    order = np.argsort(s)
    s = s[order]
    fresh = np.empty(n, bool)
    fresh[:1] = True
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    head = np.flatnonzero(fresh)
    sizes = np.diff(np.append(head, n))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(head, sizes) + 1  # what lies beyond the end ranks 0
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while h < depth and len(slots):
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)]
        turn = np.argsort(key)
        key = key[turn]
        at = at[turn]
        order[slots] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        head = np.flatnonzero(fresh)
        sizes = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(slots[head], sizes) + 1
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    if len(slots):  # what is equal so far stands by place, so that a common prefix carries over
        order[slots] = np.sort(rank[order[slots]] * n + order[slots]) % n
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    return order, slot


def kasai(data: np.ndarray, order: np.ndarray, slot: np.ndarray, cap: int = WINDOW, strips: int = 16384) -> np.ndarray:
    """Bytes, at most ``cap``, that each suffix (by place) has in common with the one before it in the
    order. Strips of the text advance together; within a strip the next value is at least one less."""
    n = len(data)
    words = words_at(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    length = -(-n // strips)
    out = np.zeros(n, np.int32)
    got = np.zeros(-(-n // length), np.int64)
    base, last = np.arange(len(got)) * length, np.full(len(got), -2)
    for t in range(length):
        i = base + t
        live = i < n
        if not live.all():
            i, got, base, last = i[live], got[live], base[live], last[live]
        j = before[i]
        # beyond ``cap`` the order is by place, and tells nothing of the next but where both move on
        got = np.where((j < 0) | ((got >= cap) & (j != last + 1)), 0, np.maximum(got - 1, 0))
        last = j
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            x = words[i[todo] + got[todo]] ^ words[np.minimum(j[todo] + got[todo], n + 8)]
            same = np.full(len(todo), 8)
            differ = x != 0
            # equal bytes before the first difference: its lowest bit tells
            low = x[differ] & (~x[differ] + U(1))
            same[differ] = (np.frexp(low.astype(np.float64))[1] - 1) // 8
            got[todo] += same
            todo = todo[(same == 8) & (got[todo] < cap)]
        # the text's end cuts a common prefix short
        got = np.minimum(np.minimum(got, cap), np.where(j < 0, 0, n - np.maximum(i, j)))
        out[i] = got
    return out


def window_classes(data: np.ndarray) -> np.ndarray:
    """A number for each place: equal if, and only if, the WINDOW bytes from there are equal."""
    # a tail of bytes that no text has keeps short suffixes from standing between equal windows
    padded = np.concatenate([data, np.full(72, 255, np.uint8)])
    order, slot = suffix_array(padded)
    common = kasai(padded, order, slot)
    return np.cumsum(common[order] < WINDOW)[slot][: len(data)]


def ranges(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of runs of consecutive places."""
    if not len(row):
        return row, place, place
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    return row[head], place[head], place[np.append(head[1:], len(row)) - 1]


def _by_row(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Of ranges sorted by row: the row and its ranges as packed numbers."""
    if not len(row):
        return
    pairs = np.stack([first, last], axis=1).astype("<i4")
    cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(row[a]), pairs[a:b].tobytes()


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows with their texts, about ``most`` bytes at a time."""
    for b in batches:
        texts: list[bytes] = []
        size = start = 0
        for k in range(b.num_rows):
            texts.append(encoded(b.column("t")[k].as_py()))
            size += len(texts[-1])
            if size >= most:
                yield b.slice(start, k + 1 - start), texts
                texts, size, start = [], 0, k + 1
        if texts:
            yield b.slice(start), texts


def _to_key_shards(shards: int):  # noqa: ANN202
    """shard, sure (the keys are known to be shared), data: rows u4 | row keys i8 | entries by row u4 | keys u8."""

    def pack(shard: int, sure: bool, rk: np.ndarray, row: np.ndarray, key: np.ndarray) -> tuple[int, bool, bytes]:
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        sizes = np.diff(np.append(head, len(row)))
        return shard, sure, np.uint32(len(head)).tobytes() + rk[row[head]].tobytes() + sizes.astype("<u4").tobytes() + key.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in sliced(batches):
            rk = b.column("rk").to_numpy().astype("<i8")
            row, key, _, _ = doc_anchors(texts)
            if not len(row):
                continue
            # sorted by key, then row: a key once for each row
            o = np.argsort(key)
            row, key = row[o], key[o]
            again = np.flatnonzero(key[1:] == key[:-1])
            if len(again):
                again = np.union1d(again, again + 1)
                o = np.lexsort((row[again], key[again]))
                row[again] = row[again][o]
                once = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
                row, key = row[once], key[once]
            head = np.append(True, key[1:] != key[:-1])
            sizes = np.diff(np.append(np.flatnonzero(head), len(key)))
            many = np.repeat(sizes > 1, sizes)
            shard = ((key >> U(40)) * U(shards) >> U(24)).astype(np.int64)
            out = []
            by_row = (np.abs(rk[row]) % shards).astype(np.int64)
            # each key once to its shard; what is shared within the batch goes back by document
            for pick, sure, to in ((head, False, shard), (many, True, by_row)):
                s, r, k = to[pick], row[pick], key[pick]
                o = np.lexsort((r, s))
                s, r, k = s[o], r[o], k[o]
                cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if y > x:
                        out.append(pack(int(s[x]), sure, rk, r[x:y], k[x:y]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], ["shard", "sure", "data"]
            )

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rk, keys: the anchors of a document that another has too."""
    for table in whole_groups(batches, "shard"):
        shard, sure_of = table.column("shard").to_numpy(), table.column("sure").to_pylist()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            rks, keys, sures = [], [], []
            for k in range(x, y):
                data = table.column("data")[k].as_py()
                n = int(np.frombuffer(data, "<u4", 1)[0])
                sizes = np.frombuffer(data, "<u4", n, 4 + 8 * n)
                rks.append(np.repeat(np.frombuffer(data, "<i8", n, 4), sizes))
                keys.append(np.frombuffer(data, "<u8", -1, 4 + 12 * n))
                sures.append(np.full(len(keys[-1]), sure_of[k]))
            rk, key, sure = np.concatenate(rks), np.concatenate(keys), np.concatenate(sures)
            order = np.argsort(key, kind="stable")
            s = key[order]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sizes = np.diff(np.append(head, len(s)))
            shared = np.empty(len(key), bool)
            shared[order] = np.repeat(sizes > 1, sizes)
            shared |= sure
            rk, key = rk[shared], key[shared]
            order = np.argsort(rk, kind="stable")
            rk, key = rk[order], key[order]
            cut = [0, *(np.flatnonzero(rk[1:] != rk[:-1]) + 1).tolist(), len(rk)] if len(rk) else [0]
            for at in range(0, len(cut) - 1, 5000):
                part = list(zip(cut[at : at + 5000], cut[at + 1 : at + 5001], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(rk[[a for a, _ in part]], pa.int64()), pa.array([key[a:b].tobytes() for a, b in part], pa.binary())], ["rk", "keys"])


FOUND_DDL = "kind int, shard bigint, id bigint, rk bigint, data binary"


class _Found:
    """Rows for the next step: kind 0, windows of a document to remove; kind 1, windows to compare by key."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int | None, int | None, bytes]] = []

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 5
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "shard", "id", "rk", "data"])


def exported(ids: np.ndarray, rk: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, texts: list[bytes]) -> bytes:
    """Runs of windows with their bytes: runs u4 | rows u4 | id i8, rk i8 of each row | row u4, first window
    u4, windows u4 of each run | bytes of all runs, zstd."""
    rows, own = np.unique(row, return_inverse=True)
    body = b"".join(texts[r][f : z + WINDOW] for r, f, z in zip(row.tolist(), first.tolist(), last.tolist(), strict=True))
    head = np.array([len(row), len(rows)], "<u4").tobytes() + np.stack([ids[rows], rk[rows]]).astype("<i8").tobytes()
    return head + np.stack([own, first, last - first + 1]).astype("<u4").tobytes() + zstandard.ZstdCompressor(1).compress(body)


def imported(data: bytes) -> tuple[np.ndarray, bytes]:
    """id, rk, first window and last window of each run; the bytes."""
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    who = np.frombuffer(data, "<i8", 2 * m, 8).reshape(2, m)
    own, first, size = np.frombuffer(data, "<u4", 3 * n, 8 + 16 * m).reshape(3, n).astype(np.int64)
    body = zstandard.ZstdDecompressor().decompress(data[8 + 16 * m + 12 * n :])
    return np.stack([*who[:, own], first, first + size - 1], axis=1), body


def _sort_shards(shards: int, shard_bytes: int = SHARD_BYTES):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, unsorted in sliced(batches, 8 * shard_bytes):
            ids = b.column("id").to_numpy()
            by_id = np.argsort(ids, kind="stable")  # so that the first of equal windows has the smallest id
            ids, rk = ids[by_id], b.column("rk").to_numpy()[by_id]
            texts = [unsorted[int(k)] for k in by_id]
            shared = [b.column("keys")[int(k)].as_py() for k in by_id]
            at = 0
            while at < len(texts):  # rows whose text makes some shards together
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 4 * shard_bytes):
                    size += len(texts[end])
                    end += 1
                row, key, first, last = doc_anchors(texts[at:end])
                keep = np.zeros(len(row), bool)
                for r in range(at, end):
                    lo, hi = np.searchsorted(row, [r - at, r - at + 1])
                    own = np.unique(np.frombuffer(b"".join(shared[r]), "<u8"))
                    if len(own) and hi > lo:
                        where = np.minimum(np.searchsorted(own, key[lo:hi]), len(own) - 1)
                        keep[lo:hi] = own[where] == key[lo:hi]
                row, key, first, last = row[keep] + at, key[keep], first[keep], last[keep]
                weight = np.cumsum(last - first + WINDOW)
                cuts = [0]
                while cuts[-1] < len(row):
                    done = weight[cuts[-1] - 1] if cuts[-1] else 0
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(weight, done + shard_bytes, side="right"))))
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    yield _one_shard(texts, ids, rk, row[x:y], key[x:y], first[x:y], last[x:y], shards)
                at = end

    return run


def _one_shard(texts: list[bytes], ids: np.ndarray, rk: np.ndarray, row: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, shards: int) -> pa.RecordBatch:
    n = len(row)
    head = np.ones(n, bool)  # of stretches: runs that follow one another share their bytes
    head[1:] = (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], n) - 1
    pieces = [texts[int(row[a])][int(first[a]) : int(last[z]) + WINDOW] for a, z in zip(starts, ends, strict=True)]
    offset = np.cumsum([0, *map(len, pieces)])[:-1]
    stretch = np.cumsum(head) - 1
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = last - first + 1
    run = np.repeat(np.arange(n), size)
    place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    own = offset[stretch[run]] + place - first[starts][stretch[run]]
    label = window_classes(data)[own]
    least = np.empty(int(label.max()) + 1, np.int64)
    least[label[::-1]] = ids[row[run]][::-1]  # the first written last
    gone = ids[row[run]] > least[label]
    out = _Found()
    for r, packed in _by_row(*ranges(row[run[gone]], place[gone])):
        out.rows.append((0, abs(int(rk[r])) % shards, int(ids[r]), int(rk[r]), packed))
    lead = ~gone  # a document's own repeats of a window go together, if another shard has it earlier
    x_run, x_first, x_last = ranges(run[lead], place[lead])
    x_row, x_key = row[x_run], key[x_run]
    shard = ((x_key >> U(40)) * U(shards) >> U(24)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = [0, *(np.flatnonzero(shard[order][1:] != shard[order][:-1]) + 1).tolist(), len(order)] if len(order) else [0]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        o = order[a:z]
        out.rows.append((1, int(shard[o[0]]), None, None, exported(ids, rk, x_row[o], x_first[o], x_last[o], texts)))
    return out.batch()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, rk, data: windows of a document to remove, found within a shard (passed on) or by comparing the
    windows that all shards have under the same keys."""
    for table in whole_groups(batches, "shard"):
        shard, kind = table.column("shard").to_numpy(), table.column("kind").to_numpy()
        known = table.filter(pa.array(kind == 0))
        yield from known.select(["id", "rk", "data"]).to_batches()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            parts = [imported(table.column("data")[k].as_py()) for k in range(x, y) if kind[k] == 1]
            if parts:
                yield merged(np.concatenate([m for m, _ in parts]), np.frombuffer(b"".join(d for _, d in parts), np.uint8))


def merged(meta: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """``meta``: id, rk, first and last window of runs whose bytes follow one another in ``data``."""
    size = meta[:, 3] - meta[:, 2] + 1
    offset = np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1)
    by_id = np.argsort(meta[:, 0], kind="stable")  # so that the first of equal windows has the smallest id
    ids, rk, first, _ = meta[by_id].T
    size, offset = size[by_id], offset[by_id]
    run = np.repeat(np.arange(len(meta)), size)
    step = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    at = offset[run] + step
    own = np.concatenate([_roll(data[k : k + CHUNK + WINDOW - 1], WINDOW) for k in range(0, len(data), CHUNK)])[at]
    order = np.argsort(own)
    own = own[order]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    leader = np.minimum.reduceat(order, head)  # of each hash the window with the smallest id
    found = np.empty(len(at), np.int64)
    found[order] = leader[np.searchsorted(own[head], own)]
    other = np.flatnonzero(ids[run] > ids[run[found]])
    words = words_at(data)
    equal = np.ones(len(other), bool)
    for k in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        equal &= words[at[other] + k] == words[at[found[other]] + k]
    gone = np.zeros(len(at), bool)
    gone[other] = equal
    if not equal.all():  # equal hashes of different windows: by their bytes
        clash = np.flatnonzero(np.isin(found, found[other[~equal]]))
        raw, best = data.tobytes(), {}
        for k in clash.tolist():
            best.setdefault(raw[at[k] : at[k] + WINDOW], ids[run[k]])
        for k in clash.tolist():
            gone[k] = ids[run[k]] > best[raw[at[k] : at[k] + WINDOW]]
    docs, row = np.unique(np.stack([ids, rk], axis=1), axis=0, return_inverse=True)
    row, place = row.ravel()[run[gone]], first[run[gone]] + step[gone]
    order = np.lexsort((place, row))
    got = list(_by_row(*ranges(row[order], place[order])))
    own = docs[[r for r, _ in got]] if got else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(own[:, 0], pa.int64()), pa.array(own[:, 1], pa.int64()), pa.array([d for _, d in got], pa.binary())], ["id", "rk", "data"])


def kept(text: bytes, starts: list[bytes]) -> tuple[bytes, int, int]:
    """What is left when these windows go; how many bytes went, in how many spans."""
    pairs = np.frombuffer(b"".join(starts), "<i4").reshape(-1, 2).astype(np.int64)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1] + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every document."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # fewer shards than tasks could be: a document has a row for each shard that shares an anchor with it
    shards = max(8, partitions // 3)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(f"`{text_col}`").alias("t")).withColumn("rk", F.xxhash64("id", "t"))
    keyed = rows.select("rk", "t").mapInArrow(_to_key_shards(shards), "shard bigint, sure boolean, data binary")
    shared = keyed.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(_shared_keys, "rk bigint, keys binary")
    shared = written(shared, "suffix-shared")
    own = shared.groupBy("rk").agg(F.collect_list("keys").alias("keys"))
    whole = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    prepared = written(
        rows.join(own, "rk", "left").select("id", "rk", F.when(F.col("keys").isNotNull(), F.col("t")).alias("t"), "keys", F.length(whole).cast("bigint").alias("n_bytes"), F.sha2(whole, 256).alias("sha"), *([whole.alias("kept")] if keep_text else [])),
        "suffix-prepared",
    )
    discard(shared)
    # windows meet in more, smaller shards than keys: a window is longer than a key
    found = prepared.where("keys IS NOT NULL").select("id", "rk", "t", "keys").mapInArrow(_sort_shards(4 * partitions), FOUND_DDL)
    windows = written(found.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "id bigint, rk bigint, data binary"), "suffix-windows")
    gone = windows.groupBy("id", "rk").agg(F.collect_list("data").alias("gone"))
    joined = prepared.join(gone, ["id", "rk"], "left")

    def finish(text: pa.Array, starts: pa.Array) -> pa.Array:
        out = [kept(encoded(x.as_py()), s.as_py()) for x, s in zip(text, starts, strict=True)]
        cols = [[len(x[0]) + x[1] for x in out], [x[1] for x in out], [x[2] for x in out], [hashlib.sha256(x[0]).hexdigest() for x in out]]
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            arrays.append(pa.array([x[0] for x in out], pa.binary()))
            names.append("kept")
        return pa.StructArray.from_arrays(arrays, names=names)

    ddl = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string" + (",kept:binary" if keep_text else "") + ">"
    back = F.when(F.col("id") != -(1 << 63), F.col("id")).alias("id")
    zero = F.lit(0).cast("bigint")
    cut = joined.where("gone IS NOT NULL").select(back, F.arrow_udf(finish, ddl)("t", "gone").alias("f")).select("id", "f.*")
    rest = joined.where("gone IS NULL").select(back, "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), *(["kept"] if keep_text else []))
    return cut.unionByName(rest)

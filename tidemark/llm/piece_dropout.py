"""SentencePiece encoding of the merge type, with seeded merge-dropout, and lossless decoding.

The pieces and their ranks come from a SentencePiece model file. Encoding repeats the best-ranked merge
of two neighbouring symbols (the leftmost of equals). A candidate merge is the pair of spans it joins;
a keyed hash of seed, variant, unit and spans decides whether it is skipped, for good, so the result
depends on nothing but the key: it is the same on every executor, after every retry.

Each unit has a key of its own, from a keyed hash of the document's id (its variant) and the unit's place, so
all occurrences of a word are cut independently, and their number of segmentations is not bounded. A worker
remembers decisions, not occurrences: for a unit and a set of skipped candidates, the merges that follow, in
order, and the segmentation they lead to. An occurrence starts with nothing skipped; the first of the merges
that its key skips leads to the next decision, and where it skips none it is done. What a key decides is
the same as if the occurrence were merged on its own, and that is what is done where a unit, or a decision, is
met once only in the texts at hand: what is remembered is what comes again.

With a number of ``variants`` instead, a document's variant is a keyed hash of its id, dealt into as many
classes, and a word is cut alike in all documents of a class.

Units are what pieces cannot cross: runs of spaces with the word after them, and line feeds. Short units
of equal length are merged together as numpy matrices; long ones by an agenda (a heap).

Decoding joins the pieces' bytes. It gives back the very text: characters without a piece, and the sign
that stands for a space where the text itself has it, are encoded as bytes.

Defined cases: null and empty texts have no ids and decode to an empty text; a null id has the variant of 0;
repeated rows have equal ids; very long texts are cut whole. Empty tables give empty results; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, holding, structs

SPACE = "▁"
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_NONE = np.int32(1 << 30)
SLICE_BYTES = 3_000_000
TABLE = 1 << 20
#: Longer units go by the agenda; places within others fit 7 bits.
LONG = 64
SPAN_BITS = 21
U = np.uint64


def spans_coded(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.int32) << 14) | (mid.astype(np.int32) << 7) | end.astype(np.int32)


def mixed(*parts: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of numbers, the same in every process."""
    h = np.array([0x243F6A8885A308D3], U)
    for p in parts:
        h = (h ^ p) * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


class Pieces:
    """The pieces of a model file: ids, ranks, which pairs merge, and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids of this model don't fit 2 bytes")
        names = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)}
        self.byte_ids = {int(names[i][1:-1], 16): i for i in special if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no piece for some byte; decoding would lose characters")
        ids = {names[i]: i for i in range(n) if i not in special}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in ids if len(p) > 1):
            raise ValueError("a piece of this model crosses units")
        self.bytes = [b""] * n
        for p, i in ids.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        self.rank = np.full(n + 1, _NONE, np.int32)
        for i in ids.values():
            self.rank[i] = order[model.get_score(i)]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 17 | b] = i
        self.pairs = pairs
        # a hash table for whole arrays of pairs: what collides moves on by a slot
        self.keys, self.into = np.full(TABLE + 64, -1, np.int64), np.full(TABLE + 64, -1, np.int32)
        self.moves = 0
        key, into = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slots(key)
        while len(key):
            at, first = np.unique(slot, return_index=True)
            free = first[self.keys[at] < 0]
            self.keys[slot[free]], self.into[slot[free]] = key[free], into[free]
            left = np.ones(len(key), bool)
            left[free] = False
            key, into, slot = key[left], into[left], slot[left] + 1
            self.moves += 1

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return (key.astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - TABLE.bit_length() + 1)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = a.astype(np.int64) << 17 | b
        key[(a < 0) | (b < 0)] = -2
        flat = key.ravel()
        at = self._slots(flat)
        out = np.where(self.keys[at] == flat, self.into[at], np.int32(-1))
        open_ = np.flatnonzero((self.keys[at] != flat) & (self.keys[at] >= 0))
        for _ in range(1, self.moves):
            if not len(open_):
                break
            at[open_] += 1
            met = self.keys[at[open_]]
            hit = met == flat[open_]
            out[open_[hit]] = self.into[at[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out.reshape(key.shape)

    def as_bytes(self, chars: str) -> list[int]:
        return [self.byte_ids[b] for b in chars.encode()]


class Encoder:
    def __init__(self, pieces: Pieces, seed: int = 7, dropout: float = 0.1, most: int = 400_000):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a probability")
        self.pieces, self.seed, self.dropout, self.most = pieces, seed, dropout, most
        self.limit = U(min(int(dropout * 2**64), 2**64 - 1))
        self.known: dict[int, dict[str, bytes]] = defaultdict(dict)
        ids = np.array(pieces.as_bytes(SPACE), "<u2")
        self.sign = ids.tobytes()
        self.forget()

    def forget(self) -> None:
        """Decisions: number 0 is the sign itself. By number: ids, unit, skipped candidates (coded); how many
        merges are as in the decision before, and the rest of them (rows of ``spans`` from ``first`` on).
        ``follow``: decision and number of the merge that is skipped next, to the decision that follows."""
        self.number: dict[str | None, int] = {None: 0}
        self.ids, self.unit, self.gone = [self.sign], [""], [b""]
        self.follow: dict[int, int] = {}
        self.alike, self.first, self.count, self.long = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
        self.spans = np.zeros((3, 0), np.int32)

    def skipped(self, key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(key, start.astype(U), mid.astype(U), end.astype(U)) < self.limit

    def key(self, variant: int, unit: str) -> int:
        return xxhash.xxh3_64_intdigest(unit.encode(), seed=(self.seed * 1_000_003 + variant) & (2**64 - 1))

    def agenda(self, unit: str, variant: int, own: int | None = None) -> list[int]:
        """One unit, with a key of its own or that of the variant: candidates in a heap by rank and place."""
        p = self.pieces
        chars = [int(p.char[ord(c)]) for c in unit]
        n = len(unit)
        symbol, end = dict(enumerate(chars)), {k: k + 1 for k in range(n)}
        before = {k: k - 1 for k in range(n)}
        key = np.array([self.key(variant, unit) if own is None else own], U)
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b not in symbol or symbol[a] < 0 or symbol[b] < 0:
                return
            into = p.pairs.get(symbol[a] << 17 | symbol[b])
            if into is None or (self.dropout and bool(self.skipped(key, np.array([a]), np.array([b]), np.array([end[b]]))[0])):
                return
            heapq.heappush(heap, (int(p.rank[into]), a, b, end[b]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if a not in symbol or b not in symbol or end[a] != b or end[b] != e:
                continue
            symbol[a] = p.pairs[symbol[a] << 17 | symbol[b]]
            end[a] = e
            del symbol[b], end[b]
            if e in before:
                before[e] = a
            offer(a)
            if a and before[a] in symbol:
                offer(before[a])
        out: list[int] = []
        for a in sorted(symbol):
            out += [symbol[a]] if symbol[a] >= 0 else p.as_bytes(unit[a])
        return out

    def together(self, units: list[str], key: np.ndarray | None, merges: list[np.ndarray] | None = None, skips: np.ndarray | None = None) -> list[bytes]:
        """Units of one length, a merge each in every round. Skipped is what the keys say; without keys, what
        ``skips`` has (sorted: unit, then span). To ``met`` go the candidates: unit, start, middle and end."""
        p, m, n = self.pieces, len(units), len(units[0])
        dropout = self.dropout if key is not None else skips is not None and len(skips)
        key = np.arange(m).astype(U) if key is None else key

        def skipped(own: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
            if skips is None:
                return self.skipped(own, x, y, z)
            code = own.astype(np.int64) << SPAN_BITS | spans_coded(x, y, z)
            return skips[np.minimum(np.searchsorted(skips, code), len(skips) - 1)] == code

        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(m, n)
        symbol = p.char[code]
        out: list[bytes] = [b""] * m
        row = np.arange(m)
        start = np.broadcast_to(np.arange(n + 1, dtype=np.int32), (m, n + 1)).copy()
        into = p.joined(symbol[:, :-1], symbol[:, 1:])
        rank = p.rank[into]  # -1 takes the last, _NONE
        if dropout and n > 1:
            rank = np.where(skipped(key[:, None], start[:, :-2], start[:, 1:-1], start[:, 2:]), _NONE, rank)

        def done(which: np.ndarray) -> None:
            left = symbol[which]
            if not len(left):
                return
            plain = (left >= 0).all(axis=1)
            data, size = left.astype("<u2").tobytes(), 2 * left.shape[1]
            for k, (r, ok) in enumerate(zip(row[which].tolist(), plain.tolist(), strict=True)):
                if ok:
                    out[r] = data[k * size : (k + 1) * size]
                else:
                    at = start[which][k].tolist()
                    ids = [x for s, a in zip(left[k].tolist(), at, strict=False) for x in ([s] if s >= 0 else p.as_bytes(units[r][a]))]
                    out[r] = np.array(ids, "<u2").tobytes()

        while True:
            if not rank.shape[1]:
                done(np.arange(len(row)))
                return out
            best = rank.argmin(axis=1)
            lines = np.arange(len(row))
            live = rank[lines, best] < _NONE
            if not live.all():
                done(np.flatnonzero(~live))
                symbol, start, into, rank, row, key, best = (x[live] for x in (symbol, start, into, rank, row, key, best))
                lines = np.arange(len(row))
            if not len(row):
                return out
            width = symbol.shape[1]
            if merges is not None:
                merges.append(np.stack([row, start[lines, best], start[lines, best + 1], start[lines, best + 2]]))
            symbol[lines, best] = into[lines, best]
            cols = np.arange(width)[None, :]
            gone = best[:, None] + 1
            symbol = symbol[cols != gone].reshape(len(row), width - 1)
            start = start[np.arange(width + 1)[None, :] != gone].reshape(len(row), width)
            slim = np.arange(width - 1)[None, :] != np.minimum(best, width - 2)[:, None]
            into, rank = (x[slim].reshape(len(row), width - 2) for x in (into, rank))
            for shift in (-1, 0):  # the pairs on both sides of the new symbol
                at = best + shift
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                if len(ok):
                    a = at[ok]
                    new = p.joined(symbol[ok, a], symbol[ok, a + 1])
                    r = p.rank[new]
                    if dropout:
                        r = np.where(skipped(key[ok], start[ok, a], start[ok, a + 1], start[ok, a + 2]), _NONE, r)
                    into[ok, a], rank[ok, a] = new, r

    def learn(self, units: set[str], variant: int) -> None:
        known = self.known[variant]
        by_length: dict[int, list[str]] = defaultdict(list)
        for u in units:
            if len(u) > LONG:
                known[u] = np.array(self.agenda(u, variant), "<u2").tobytes()
            else:
                by_length[len(u)].append(u)
        for same in by_length.values():
            for k in range(0, len(same), 20_000):
                part = same[k : k + 20_000]
                keys = np.array([self.key(variant, u) for u in part], U)
                known.update(zip(part, self.together(part, keys), strict=True))

    def study(self, units: list[str], gone: list[bytes], alike: np.ndarray) -> None:
        """Numbers new decisions. Long units are left to their occurrences."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, unit in enumerate(units):
            by_length[min(len(unit), LONG + 1)].append(k)
        ids: list[bytes] = [b""] * len(units)
        whose, spans = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int32)]
        for n, same in by_length.items():
            for x in range(0, len(same) if n <= LONG else 0, 20_000):
                part = same[x : x + 20_000]
                own = [gone[k] for k in part]
                skips = np.repeat(np.arange(len(part)) << SPAN_BITS, [len(g) // 4 for g in own]) | np.frombuffer(b"".join(own), np.int32)
                merges: list[np.ndarray] = []
                for k, got in zip(part, self.together([units[k] for k in part], None, merges, np.sort(skips)), strict=True):
                    ids[k] = got
                if merges:
                    turn = np.repeat(np.arange(len(merges)), [m.shape[1] for m in merges])
                    of, *span = np.concatenate(merges, axis=1)
                    of = np.array(part)[of]
                    new = turn >= alike[of]
                    whose.append(of[new])
                    spans.append(np.stack(span).astype(np.int32)[:, new])
        of = np.concatenate(whose)
        count = np.bincount(of, minlength=len(units))
        self.first = np.concatenate([self.first, self.spans.shape[1] + np.cumsum(count) - count])
        self.spans = np.concatenate([self.spans, np.concatenate(spans, axis=1)[:, np.argsort(of, kind="stable")]], axis=1)
        self.count, self.alike = np.concatenate([self.count, count]), np.concatenate([self.alike, alike])
        self.long = np.concatenate([self.long, np.array([len(u) > LONG for u in units], bool)])
        self.ids += ids
        self.unit += units
        self.gone += gone

    def decided(self, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The decisions that units under these keys come to; -1 for units to be merged alone."""
        out = np.where(self.long[number] & (number >= 0), -1, number)
        live = np.flatnonzero(out >= 0)
        while len(live):
            of = out[live]
            count = self.count[of]
            whose = np.repeat(np.arange(len(of)), count)
            turn = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
            hit = np.flatnonzero(self.skipped(key[live[whose]], *self.spans[:, np.repeat(self.first[of], count) + turn]))
            hit = hit[np.append(True, whose[hit][1:] != whose[hit][:-1])] if len(hit) else hit
            live = live[whose[hit]]
            steps, back = np.unique(out[live] << 7 | turn[hit], return_inverse=True)
            times = np.bincount(back)
            new = [x for x, n in zip(steps.tolist(), times.tolist(), strict=True) if n > 1 and x not in self.follow]
            if new:
                before, skip = np.array(new) >> 7, np.array(new) & 127
                codes = spans_coded(*self.spans[:, self.first[before] + skip])
                at, whole = len(self.ids), before.tolist()
                self.study([self.unit[n] for n in whole], [self.gone[n] + c.tobytes() for n, c in zip(whole, codes, strict=True)], self.alike[before] + skip)
                self.follow.update(zip(new, range(at, at + len(new)), strict=True))
            to = np.fromiter(map(self.follow.get, steps.tolist(), repeat(-1)), np.int64, len(steps))[back]
            out[live] = to
            live = live[to >= 0]
        return out

    def alone(self, units: list[str], key: np.ndarray) -> list[bytes]:
        """Each unit merged under its own key."""
        out = [b""] * len(units)
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, u in enumerate(units):
            by_length[min(len(u), LONG + 1)].append(k)
        for n, same in by_length.items():
            for x in range(0, len(same), 20_000):
                part = same[x : x + 20_000]
                if n > LONG:
                    got = [np.array(self.agenda(units[k], 0, int(key[k])), "<u2").tobytes() for k in part]
                else:
                    got = self.together([units[k] for k in part], key[part])
                for k, ids in zip(part, got, strict=True):
                    out[k] = ids
        return out

    def encode_placed(self, texts: list[str | None], owners: list[int]) -> list[bytes]:
        """Ids of each text, each unit under the key of its text's owner and its place."""
        if len(self.ids) > self.most:
            self.forget()
        units: list[str | None] = []
        ends = [0]
        for x in texts:
            for k, part in enumerate(x.split(SPACE)) if x else ():
                if k:
                    units.append(None)
                units += _UNIT.findall((SPACE if k == 0 else "") + part.replace(" ", SPACE))
            ends.append(len(units))
        get = self.number.get
        number = np.fromiter(map(get, units, repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(number < 0).tolist()
        times = Counter(map(units.__getitem__, unknown))
        fresh = [u for u, n in times.items() if n > 1]
        if fresh:
            self.number.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh)), strict=True))
            self.study(fresh, [b""] * len(fresh), np.zeros(len(fresh), np.int64))
            number[unknown] = np.fromiter(map(get, map(units.__getitem__, unknown), repeat(-1)), np.int64, len(unknown))
        sizes = np.diff(ends)
        place = np.arange(len(units)) - np.repeat(ends[:-1], sizes)
        key = mixed(np.repeat(np.array(owners, np.int64).view(U), sizes), place.astype(U))
        if self.dropout:
            step = 100_000
            number = np.concatenate([np.zeros(0, np.int64), *(self.decided(number[k : k + step], key[k : k + step]) for k in range(0, len(units), step))])
        else:
            number[self.long[number]] = -1
        out = list(map(self.ids.__getitem__, number.tolist()))
        rest = np.flatnonzero(number < 0)
        for k, ids in zip(rest.tolist(), self.alone([units[k] for k in rest.tolist()], key[rest]), strict=True):
            out[k] = ids
        return [b"".join(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str | None], variants: list[int]) -> list[bytes]:
        """Ids (little-endian, 2 bytes each) of each text."""
        if sum(map(len, self.known.values())) > self.most:
            self.known.clear()
        cut = []
        new: dict[int, set[str]] = defaultdict(set)
        for x, v in zip(texts, variants, strict=True):
            parts = []
            for k, part in enumerate(x.split(SPACE)) if x else ():
                parts.append(_UNIT.findall((SPACE if k == 0 else "") + part.replace(" ", SPACE)))
                known = self.known[v]
                new[v].update(u for u in parts[-1] if u not in known)
            cut.append(parts)
        for v, units in new.items():
            self.learn(units, v)
        return [self.sign.join([b"".join(map(self.known[v].__getitem__, units)) for units in parts]) for parts, v in zip(cut, variants, strict=True)]


def decode(pieces: Pieces, ids: bytes) -> str:
    """The text that these ids (little-endian, 2 bytes each) came from."""
    data = b"".join(map(pieces.bytes.__getitem__, np.frombuffer(ids, "<u2").tolist()))
    return data[1:].decode("utf-8")


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, seed: int, dropout: float) -> Encoder:
    """One for each worker process and key."""
    key = (path, seed, dropout)
    if key not in _loaded:
        _loaded[key] = Encoder(Pieces(path), seed, dropout)
    return _loaded[key]


def forget() -> None:
    _loaded.clear()


def variant_of(identity: Column, seed: int, variants: int | None) -> Column:
    h = F.xxhash64(F.lit(seed), F.coalesce(identity.cast("string"), F.lit("0")))
    return h if variants is None else F.pmod(h, F.lit(variants)).cast("int")


def encode_docs(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out: str = "__pieces", seed: int = 7, dropout: float = 0.1, variants: int | None = None, keep_ids: bool = True) -> DataFrame:
    """Adds struct ``out``: variant, n_tokens, ids_crc32 (of the ids, 2 bytes each), lossless (the ids
    decode to the text) and, unless left out, ids."""
    fields = [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())]
    ddl = "n_tokens:bigint,ids_crc32:bigint,lossless:boolean"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ",ids:array<int>"

    def run(text: pa.Array, variant: pa.Array) -> pa.Array:
        holding("piece dropout", forget)
        enc = encoder(path, seed, dropout)
        encode = enc.encode_placed if variants is None else enc.encode
        columns: list[list] = [[] for _ in fields]
        at, sizes = 0, pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        while at < len(text):  # some megabytes at a time
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, side="right")))
            texts = text.slice(at, n).to_pylist()
            owners = variant.slice(at, n).to_pylist()
            at += n
            for x, ids in zip(texts, encode(texts, owners), strict=True):
                columns[0].append(len(ids) // 2)
                columns[1].append(zlib.crc32(ids))
                columns[2].append(decode(enc.pieces, ids) == (x or ""))
                if keep_ids:
                    columns[3].append(np.frombuffer(ids, "<u2").astype(np.int32))
        if keep_ids:
            ends = np.cumsum([0, *map(len, columns[3])], dtype=np.int32)
            flat = np.concatenate(columns[3]) if columns[3] else np.zeros(0, np.int32)
            del columns[3:]
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=False)] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            give_back()
            return pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields])
        give_back()
        return structs(pa.struct(fields), columns)

    v = variant_of(F.col(f"`{id_col}`"), seed, variants)
    udf = F.arrow_udf(run, f"struct<{ddl}>")
    return docs.withColumn(out, udf(F.col(f"`{text_col}`"), v).withField("variant", v))


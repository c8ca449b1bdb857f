"""Token ids in binary files, coded by a static range asymmetric numeral system.

Writing. Documents are dealt by ranges of doc_id, so that the files, read by number, hold them in
ascending order. A task tokenises its documents in order and cuts them into segments of at most
``segment_tokens`` tokens or so (a longer document is one segment). One frequency table, scaled to
2**SCALE_BITS, is shared by all blocks of a segment. A block is BLOCK_TOKENS tokens, dealt in turn to
LANES interleaved coders; each block starts from fresh states, so any block can be decoded alone, and
all blocks of a segment advance together as numpy vectors.

A frame (one segment) is bytes, little-endian:

    magic 4s | version u2 | scale bits u1 | lanes u2 | steps u4 | documents u4 | symbols u4 | tokens u8 | blocks u4
    doc ids i8[documents] (null: the smallest i8) | tokens by document u4[documents]
    symbols u4[symbols] | frequencies u4[symbols]
    checkpoints: first token u8, first word u8, words u4, crc32 of states and words u4, [blocks]
    states u8[blocks][lanes] | words u4[...] | crc32 of all before it u4

The text parts of the frame that compress (document table, frequency table) are deflated together.
Frames are kept as rows of Parquet files, whose writers commit whole files only and need no local disk.

Defined cases: a null or empty text has the end token alone; a very long one is a segment of its own; a null
doc_id sorts first; rows with equal doc_id follow by their text; an empty table gives files without frames.
Files hold ids and tokens only, whatever other columns there are and however they are called.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"TRNS", 1
SCALE_BITS, LANES, BLOCK_TOKENS = 18, 32, 1 << 14
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHBHIIIQI")
CHECKPOINT = np.dtype([("token", "<u8"), ("word", "<u8"), ("words", "<u4"), ("crc", "<u4")])
NO_ID = -(1 << 63)


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of 1 or more that add up to 2**bits, near in proportion to the counts."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more symbols than the scale can tell apart")
    spare = total - len(counts)
    out = 1 + (counts * (spare / counts.sum())).astype(np.int64)
    out[np.argmax(counts)] += total - out.sum()
    return out.astype(np.uint64)


def encode(tokens: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, lanes: int = LANES, block: int = BLOCK_TOKENS, bits: int = SCALE_BITS) -> bytes:
    """One frame. ``tokens``: those of all its documents, one after the other."""
    counts = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    ranks, counts = place[tokens], counts[symbols]
    freq = scaled(counts, bits) if len(symbols) else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(symbols) else freq
    n = len(tokens)
    steps = max(1, -(-min(block, n) // lanes))
    blocks = -(-n // (steps * lanes))
    padded = np.full(blocks * steps * lanes, int(np.argmax(counts)) if n else 0, np.int32)
    padded[:n] = ranks
    by_step = padded.reshape(blocks, steps, lanes).transpose(1, 0, 2)
    state = np.full((blocks, lanes), LOW, np.uint64)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    full = np.zeros((steps, blocks, lanes), bool)
    room = np.uint64(63 - bits)
    b = np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = by_step[t]
        f, c = freq[s], first[s]
        out = state >= (f << room)
        full[t] = out
        words[t] = state.astype(np.uint32)
        state = np.where(out, state >> np.uint64(32), state)
        q = state // f
        state = (q << b) + (state - q * f) + c
    marks = np.zeros(blocks, CHECKPOINT)
    parts, at = [], 0
    for k in range(blocks):
        w = words[:, k][full[:, k]].astype("<u4")
        st = state[k].astype("<u8").tobytes()
        marks[k] = (k * steps * lanes, at, len(w), zlib.crc32(w.tobytes(), zlib.crc32(st)))
        parts.append(w)
        at += len(w)
    table = zlib.compress(
        doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1
    )
    body = (
        HEAD.pack(MAGIC, VERSION, bits, lanes, steps, len(doc_ids), len(symbols), n, blocks)
        + struct.pack("<I", len(table)) + table + marks.tobytes() + state.astype("<u8").tobytes()
        + (np.concatenate(parts).tobytes() if parts else b"")
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """What a frame's head tells, and decoding of some or all of its blocks."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged frame: its checksum differs")
        magic, version, self.bits, self.lanes, self.steps, docs, symbols, self.n_tokens, self.blocks = HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a frame of this format")
        at = HEAD.size
        size = struct.unpack_from("<I", data, at)[0]
        table = zlib.decompress(data[at + 4 : at + 4 + size])
        at += 4 + size
        self.doc_ids = np.frombuffer(table, "<i8", docs)
        self.lengths = np.frombuffer(table, "<u4", docs, 8 * docs)
        self.symbols = np.frombuffer(table, "<u4", symbols, 12 * docs)
        self.freq = np.frombuffer(table, "<u4", symbols, 12 * docs + 4 * symbols).astype(np.uint64)
        self.marks = np.frombuffer(data, CHECKPOINT, self.blocks, at)
        at += CHECKPOINT.itemsize * self.blocks
        self.states = np.frombuffer(data, "<u8", self.blocks * self.lanes, at).reshape(self.blocks, self.lanes)
        at += 8 * self.blocks * self.lanes
        self.words = np.frombuffer(data[at:-4], "<u4")

    def decode(self, blocks: slice = slice(None)) -> np.ndarray:
        """The tokens of these blocks; each can be had without the others."""
        marks, state = self.marks[blocks], self.states[blocks].astype(np.uint64)
        if not len(marks):
            return np.zeros(0, np.uint32)
        for m, st in zip(marks, self.states[blocks], strict=True):
            w = self.words[int(m["word"]) : int(m["word"]) + int(m["words"])]
            if zlib.crc32(w.tobytes(), zlib.crc32(st.tobytes())) != int(m["crc"]):
                raise ValueError("damaged block: its checksum differs")
        slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        words = np.append(self.words, np.uint32(0)).astype(np.uint64)
        ptr = marks["word"].astype(np.int64)
        out = np.empty((self.steps, len(marks), self.lanes), np.uint32)
        mask, b = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for t in range(self.steps):
            slot = state & mask
            s = slots[slot.astype(np.int64)]
            out[t] = s
            state = self.freq[s] * (state >> b) + slot - first[s]
            low = state < LOW
            if low.any():
                order = np.cumsum(low, axis=1)
                at = np.minimum(ptr[:, None] + order - 1, len(words) - 1)
                state = np.where(low, (state << np.uint64(32)) | words[at], state)
                ptr = ptr + order[:, -1]
        got = self.symbols[out.transpose(1, 0, 2).ravel()]
        start = int(marks[0]["token"])
        return got[: self.n_tokens - start]


Tokenise = Callable[[list[str]], list[bytes]]


class WordCached:
    """Token ids (little-endian, 2 bytes each) of whole texts by a vocabulary file of the tokenizers
    library whose pre-tokeniser never joins what a space or line feed parts, and drops both; so the
    ids of a text are those of its pieces between them, and the library sees each piece once."""

    #: Marks that make one token's worth after a word; those of special tokens and contractions are left out.
    STOPS = ".,!?:;%$#&*"

    def __init__(self, path: str, most: int = 1_400_000):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are kept as the machine has them, and the format is little-endian")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 2 bytes")
        self.most, self.known = most, {}
        # ids that end a word, if every byte has one that does and one that doesn't
        words = self.library.get_vocab()
        suffix = "</w>"
        whole = all(f"{c}{suffix}" in words for c in words if len(c) == 1)
        self.is_end = None
        if whole and any(w.endswith(suffix) for w in words):
            self.is_end = np.zeros(1 << 16, bool)
            self.is_end[[i for w, i in words.items() if w.endswith(suffix)]] = True
        # whether letters below U+0100, whose case depends on no other, become small ones
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        normalise = self.library.normalizer
        self.lowers = normalise is not None and all(normalise.normalize_str(c) == c.lower() for c in letters)
        # whether a word of a-z reaches the model as it stands: it is whole, and no added token is part of one
        az, split = "abcdefghijklmnopqrstuvwxyz", self.library.pre_tokenizer
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.direct = self.lowers and split is not None and split.pre_tokenize_str(az) == [(az, (0, 26))] and not any(t.isalpha() for t in added)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {}
        get = self.known.get
        found: list[bytes | tuple[list, dict[int, str]]] = []
        new: set[str] = set()
        for x in texts:
            pieces = x.replace("\n", " ").split(" ")
            ids = list(map(get, pieces))
            try:
                found.append(b"".join(ids))
            except TypeError:  # None: pieces not yet known
                missed = {k: pieces[k] for k, i in enumerate(ids) if i is None}
                new.update(missed.values())
                found.append((ids, missed))
        self._learn(new)
        out = []
        for x in found:
            if not isinstance(x, bytes):
                ids, missed = x
                for k, p in missed.items():
                    ids[k] = self.known[p]
                x = b"".join(ids)
            out.append(x)
        return out

    def _learn(self, new: set[str]) -> None:
        """Pieces that are words, marks, or words and marks have the ids of both, one after the other. Words (in
        lower case, if the vocabulary makes no difference) and marks are encoded as one text, whose ids are
        parted again at the ends of words; other pieces one by one."""
        known, stops, lowers = self.known, self.STOPS, self.lowers
        parted: list[str] = []
        words: list[str] = []
        marked: list[str] = []
        odd: list[str] = []
        for p in new if self.is_end is not None else ():
            word = p if p.isalpha() else p.rstrip(stops)
            if p and (not word or word.isalpha()) and (p.isascii() or max(p) < "\u0100"):
                parted.append(p)
                words.append(word.lower() if lowers else word)
                marked.append(p[len(word) :])
            else:
                odd.append(p)
        if self.is_end is None:
            odd = list(new)
        plain = [w for w in {*words, *marked} if w and w not in known]
        if self.direct and plain:
            model = self.library.model.tokenize
            for w in plain:
                if w.isascii() and w.isalpha():
                    known[w] = array("H", [t.id for t in model(w)]).tobytes()
            plain = [w for w in plain if w not in known]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            cuts = (2 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                odd += part
                continue
            data = ids.tobytes()
            known.update(zip(part, [data[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        for k in range(0, len(odd), 20_000):
            part = odd[k : k + 20_000]
            for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[p] = array("H", e.ids).tobytes()
        for p, word, marks in zip(parted, words, marked, strict=True):
            if not marks:
                known[p] = known[word]
            else:
                known[p] = known[word] + known[marks] if word else known[marks]


_tokenisers: dict[str, WordCached] = {}


def tokeniser(path: str) -> WordCached:
    """One for each worker process, with what it has learnt."""
    if path not in _tokenisers:
        _tokenisers[path] = WordCached(path)
    return _tokenisers[path]


FRAME_SCHEMA = "part int, segment int, first_token bigint, n_tokens bigint, frame binary"


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, segment_tokens: int = 2_000_000) -> None:
    """Writes the files; ``first_token`` of a frame counts from the start of its file (``part``)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u2").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, done = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        tokens: list[bytes] = []
        held = 0
        tokenise = tokeniser(vocabulary)

        def frame() -> pa.RecordBatch:
            nonlocal segment, done, held, ids, tokens
            all_tokens = np.frombuffer(b"".join(tokens), "<u2")
            data = encode(all_tokens, np.array(ids, np.int64), np.array([len(x) // 2 for x in tokens], np.int64))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([done], pa.int64()), pa.array([len(all_tokens)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "segment", "first_token", "n_tokens", "frame"],
            )
            segment, done, held, ids, tokens = segment + 1, done + len(all_tokens), 0, [], []
            return out

        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                for i, x in zip(rows.column(0).to_pylist(), tokenise([x or "" for x in rows.column(1).to_pylist()]), strict=True):
                    if held and held + len(x) // 2 >= segment_tokens:
                        yield frame()
                    ids.append(NO_ID if i is None else i)
                    tokens.append(x + end)
                    held += len(x) // 2 + 1
        if ids:
            yield frame()

    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    ordered = rows.repartitionByRange(n, "i", F.xxhash64("t")).sortWithinPartitions("i", "t")
    ordered.mapInArrow(encoded, FRAME_SCHEMA).write.option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, 4 bytes each) of every document, from the files."""
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids binary", lambda ids: ids.tobytes())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()))


def _read(spark: SparkSession, path: str, schema: str, value: Callable[[np.ndarray], object]) -> DataFrame:
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    # a row for each file, as many as tasks have written: the driver adds them up
    totals = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, starts = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "part int, before bigint")
    last = schema.rpartition(", ")[2].split()[0]
    kind = pa.binary() if last == "ids" else pa.int64()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, frame in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = Frame(frame.as_buffer().to_pybytes())
                tokens = f.decode()
                ends = np.cumsum(f.lengths, dtype=np.int64)
                begins = ends - f.lengths
                for k in range(0, len(ends), 2000):
                    e, s = ends[k : k + 2000], begins[k : k + 2000]
                    ids = [None if i == NO_ID else i for i in f.doc_ids[k : k + 2000].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(s + first), pa.array(e - s), pa.array([value(tokens[x:y].astype("<u4")) for x, y in zip(s, e, strict=True)], kind)],
                        ["doc_id", "start", "n_tokens", last],
                    )

    placed = frames.join(F.broadcast(offsets), "part").select((F.col("first_token") + F.col("before")).alias("at"), "frame")
    return placed.mapInArrow(decoded, schema)

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import docs, empty, prose
from tidemark.llm import token_files as T
from tidemark.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000, 40_000])
def test_frame_round_trip(n):
    r = np.random.default_rng(n)
    tokens = np.minimum(r.zipf(1.3, n), 49407).astype(np.uint32)
    f = T.Frame(T.encode(tokens, np.arange(3), np.array([n, 0, 0])))
    assert (f.decode() == tokens).all() and f.n_tokens == n
    for k in range(f.blocks):  # any block alone
        start = int(f.marks[k]["token"])
        assert (f.decode(slice(k, k + 1)) == tokens[start : start + f.steps * f.lanes]).all()


def test_frame_of_one_symbol_and_of_all():
    for tokens in (np.full(5000, 7, np.uint32), np.arange(49408, dtype=np.uint32)):
        assert (T.Frame(T.encode(tokens, np.array([1]), np.array([len(tokens)]))).decode() == tokens).all()


def test_entropy_is_met():
    r = np.random.default_rng(1)
    p = 1 / np.arange(1, 1001) ** 1.2
    tokens = r.choice(1000, 300_000, p=p / p.sum()).astype(np.uint32)
    q = np.bincount(tokens) / len(tokens)
    bits = -(q[q > 0] * np.log2(q[q > 0])).sum() * len(tokens)
    assert len(T.encode(tokens, np.array([1]), np.array([len(tokens)]))) * 8 < 1.08 * bits


def test_damage_is_seen():
    data = bytearray(T.encode(np.arange(2000, dtype=np.uint32) % 50, np.array([1]), np.array([2000])))
    data[len(data) // 2] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        T.Frame(bytes(data))


def test_query_matches_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [prose(120, k) for k in range(50)] + ["", None, "<|endoftext|> x<|startoftext|>y", "İΣ ß é ́a\n̈b", "a b\tc\r\nd e\x1cf", "it's WE'LL 123", "  \n\n ", "漢字 🎉🎉", "x" * 30_000, prose(20_000, 7)]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    path = shared_dir(spark, "t")
    T.write_files(docs(spark, rows), path, PATH, segment_tokens=3000)
    got = sorted(T.read_digests(spark, path).collect())
    at = 0
    for r, (k, x) in zip(got, sorted(rows), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_files(spark, path).collect()}
    assert back[0][:-1] == t.encode(texts[0], add_special_tokens=False).ids


def test_nulls_repeats_and_empty(spark):
    path = shared_dir(spark, "t")
    T.write_files(docs(spark, [("null", "b"), (5, "a"), (5, "a"), (4, None)]).withColumnRenamed("lang", "i").withColumnRenamed("source", "t"), path, PATH)
    got = sorted(T.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 4, 5, 5] and got[1].n_tokens == 1
    path = shared_dir(spark, "t")
    T.write_files(empty(spark), path, PATH)
    assert T.read_digests(spark, path).count() == 0


def test_a_word_is_encoded_once():
    """Whatever its case and the marks after it: the library isn't asked again for a word that it has seen."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    known = T.WordCached(PATH)
    known(["unheardof wörtlich . , ,! ªºµß"])
    known.library = None
    again = ["Unheardof, UNHEARDOF. WÖRTLICH,! wörtlich", "ªºµß. Wörtlich"]
    assert [np.frombuffer(x, "<u2").tolist() for x in known(again)] == [t.encode(x, add_special_tokens=False).ids for x in again]


def test_odd_words_match_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abzAZ'.,!é\u00c9µßªº×9_#\u0301Σİ|<>") for _ in range(r.randrange(0, 9))) for _ in range(40)) for _ in range(300)]
    texts += ["<|ENDOFTEXT|> <|endoftext|>, a<|startoftext|>b", "I'LL don't 'S, x.", "endoftext startoftext."]
    known = T.WordCached(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in known(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]

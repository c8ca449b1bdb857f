import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.helpers import docs, empty, prose
from tidemark.llm import piece_dropout as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [prose(300, k) for k in range(5)] + ["hello world", " lead and trail ", "a  b   c    d", "x\n\n y\tz", "naïve façade Straße größer", "漢字かな🎉", "▁ own ▁▁sign", "", "\n", "abc" * 400, "tionsh " * 50]


@pytest.fixture(scope="module")
def pieces():
    return P.Pieces(MODEL)


def ids(data):
    return np.frombuffer(data, "<u2").tolist()


def test_without_dropout_equals_the_library(pieces):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    e = P.Encoder(pieces, dropout=0.0)
    xs = [x for x in TEXTS if P.SPACE not in x]
    assert [ids(x) for x in e.encode(xs, [0] * len(xs))] == sp.encode(xs)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_agenda_equals_matrix_and_decodes(pieces, dropout):
    e = P.Encoder(pieces, seed=3, dropout=dropout)
    units = {u for x in TEXTS for u in P._UNIT.findall(P.SPACE + x.replace(" ", P.SPACE)) if len(u) <= P.LONG}
    for v in (0, 1):
        e.learn(units, v)
        for u in units:
            assert ids(e.known[v][u]) == e.agenda(u, v), u
    for v in (0, 1):
        for x, data in zip(TEXTS, e.encode(TEXTS, [v] * len(TEXTS)), strict=True):
            assert P.decode(pieces, data) == x


def test_variants_and_seeds_differ(pieces):
    a, b = P.Encoder(pieces, seed=1, dropout=0.2), P.Encoder(pieces, seed=2, dropout=0.2)
    x = [TEXTS[0]]
    assert a.encode(x, [0]) != a.encode(x, [1]) and a.encode(x, [0]) != b.encode(x, [0])
    assert a.encode(x, [0]) == P.Encoder(pieces, seed=1, dropout=0.2).encode(x, [0])
    few = len(P.Encoder(pieces, dropout=0.0).encode(x, [0])[0])
    assert few < len(a.encode(x, [0])[0]) < len(P.Encoder(pieces, dropout=1.0).encode(x, [0])[0])


def test_share_of_skipped_merges(pieces):
    e = P.Encoder(pieces, dropout=0.1)
    n = 100_000
    got = e.skipped(np.arange(n).astype(np.uint64), np.zeros(n), np.ones(n), np.full(n, 2)).mean()
    assert abs(got - 0.1) < 0.005


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_placed_units_equal_the_agenda_under_their_own_keys(pieces, dropout):
    e = P.Encoder(pieces, dropout=dropout)
    for _ in range(2):  # the second time from what is known
        for x, owner, data in zip(TEXTS, range(-3, 99), e.encode_placed(TEXTS, list(range(-3, len(TEXTS) - 3))), strict=False):
            assert P.decode(pieces, data) == x
            if P.SPACE not in x:
                units = P._UNIT.findall(P.SPACE + x.replace(" ", P.SPACE)) if x else []
                keys = [int(P.mixed(np.array([owner], np.int64).view(np.uint64), np.array([k], np.uint64))[0]) for k in range(len(units))]
                assert ids(data) == [i for u, k in zip(units, keys, strict=True) for i in e.agenda(u, 0, k)]


def test_cuts_of_a_word_are_not_capped(spark, pieces):
    """Within one document, and over documents: more than four segmentations of one word."""
    d = docs(spark, [(0, "internationalisation " * 200), *((k, "internationalisation") for k in range(1, 101))])
    rows = P.encode_docs(d, MODEL, dropout=0.3, variants=None).select("doc_id", "__pieces.*").collect()
    assert len({tuple(r.ids) for r in rows if r.doc_id}) > 4
    one = P.Encoder(pieces, dropout=0.3)
    assert len({one.encode_placed(["x internationalisation"], [k])[0] for k in range(100)}) > 4
    ids = next(list(r.ids) for r in rows if r.doc_id == 0)
    names = [pieces.bytes[i] for i in ids]
    starts = [k for k, x in enumerate(names) if x.startswith(b" ")] + [len(names)]
    assert len({tuple(ids[a:b]) for a, b in zip(starts, starts[1:], strict=False)}) > 4


def test_frame(spark, pieces):
    d = docs(spark, [*enumerate(TEXTS), ("null", None), (7, "x")]).withColumnRenamed("lang", "ids")
    rows = P.encode_docs(d, MODEL).select("text", "__pieces.*").collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.lossless for r in rows)
    for r in rows:
        assert P.decode(pieces, np.array(r.ids, "<u2").tobytes()) == (r.text or "") and r.n_tokens == len(r.ids)
    assert P.encode_docs(empty(spark), MODEL).count() == 0

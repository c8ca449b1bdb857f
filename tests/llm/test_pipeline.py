"""The pipeline against brute force, stage by stage, on a small table."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.helpers import SCHEMA, prose, words
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_jaccard_join import brute as near
from tests.llm.test_line_dedup import brute as repeated
from tidemark.llm import piece_dropout


def texts():
    r = random.Random(8)
    boiler = "a line of boiler plate that many documents share, word by word"
    item = " ".join(words(20, 7777))
    out = []
    for k in range(40):
        x = prose(150, 100 + k, 5000)
        if k % 5 == 0:
            x = boiler + "\n" + x
        if k % 11 == 0:
            x += "\n" + item
        out.append(x)
    out.append(out[1])  # an exact copy
    w = words(160, 4242, 5000)
    out.append(" ".join(w))
    w[80] = "changed"
    out.append(" ".join(w).upper().lower() + " ")  # a near copy in one line
    out += [" | ".join(words(120, 3)), "too short", None, "", " ".join(x.upper() + "!!" for x in words(100, 9))]
    r.shuffle(out)
    return list(enumerate(out)), [(1, item), (2, "nothing like it at all here"), (3, None)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = texts()
    d = spark.createDataFrame([(k, x, "en", "s", len(x) if x is not None else None) for k, x in rows], SCHEMA)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "piece_dropout"]
    docs, seen = d, []
    for name, stage in C.STAGES:
        out = tmp_path / name
        stage(spark, docs, str(tmp_path)).write.parquet(str(out))
        docs = spark.read.parquet(str(out))
        if name != "piece_dropout":
            assert docs.schema.simpleString() == d.schema.simpleString()
        seen.append({r.doc_id: r for r in docs.collect()})
    first = {k: x for k, x in rows if k in seen[0]}
    junk = {k for k, x in rows if not x or x == "too short" or " | " in x or "!!" in x}
    assert set(first) == {k for k, _ in rows} - junk
    gone = repeated(list(first.items()), 1)
    left = {k: "\n".join(v for p, v in enumerate(x.split("\n")) if p not in gone[k, x]) for k, x in first.items()}
    left = {k: x for k, x in left.items() if x.strip() or not gone[k, first[k]]}
    assert {k: r.text for k, r in seen[1].items()} == left and all(r.n_chars == len(r.text) for r in seen[1].values())
    heads = {g for _, _, _, g in near(list(left.items()))}
    assert set(seen[2]) == heads and len(heads) < len(left)
    clean = {k for k in heads if not contamination(left[k], items)[2]}
    assert set(seen[3]) == clean == set(seen[4])
    pieces = piece_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    enc = piece_dropout.Encoder(pieces, 7, 0.1)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for k, r in seen[4].items():
        assert r.lossless and sp.decode(list(r.ids)) == left[k]
        units = piece_dropout._UNIT.findall("▁" + left[k].replace(" ", "▁"))
        keys = piece_dropout.mixed(np.array([r.variant]).view(np.uint64), np.arange(len(units)).astype(np.uint64)).tolist()
        plain = [i for u, own in zip(units, keys, strict=True) for i in enc.agenda(u, 0, own)]
        assert list(r.ids) == plain
    whole = {r.doc_id: list(r.ids) for r in C.run(spark, str(tmp_path)).collect()}
    assert whole == {k: list(r.ids) for k, r in seen[4].items()}


def test_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], SCHEMA)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.createDataFrame([(1, prose(120, 1), "en", "s", 1)] * 3 + [(None, prose(120, 2), None, None, None)], SCHEMA)
    d = d.withColumns({c: F.lit(0) for c in ("n", "c", "g", "name", "k", "t", "rk", "items", "score")})
    for _, stage in C.STAGES[:-1]:
        new = stage(spark, d, str(tmp_path))
        assert new.columns == d.columns
        d = new
    assert sorted(r.doc_id or 0 for r in C.STAGES[-1][1](spark, d, str(tmp_path)).collect()) == [0, 1]

from types import SimpleNamespace

import pytest

from tidemark.llm.common import clear, discard, holding, row_key, shared_dir, written


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"{master}-1"))


def test_shared_folder():
    assert shared_dir(session("spark://x:7077", "hdfs://n/c/"), "t").startswith("hdfs://n/c/t-")
    local = session("local[4]")
    a, b = shared_dir(local, "t"), shared_dir(local, "t")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://x:7077"), "t")


def test_written_and_discarded(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = written(spark.range(10), "t")
    assert t.count() == 10 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    discard(t)
    with pytest.raises(Exception):  # noqa: B017
        t.count()


def test_clear_removes_what_is_left(spark):
    t = written(spark.range(3), "t")
    clear(spark)
    with pytest.raises(Exception):  # noqa: B017
        t.count()


def test_settings_come_back_after_tables_written_together(spark):
    from concurrent.futures import ThreadPoolExecutor

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 777)
    try:
        with ThreadPoolExecutor(4) as pool:
            assert [t.count() for t in pool.map(lambda n: written(spark.range(n), "t"), range(1, 9))] == list(range(1, 9))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_row_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (2, "a"), (1, "a")], "i long, t string").select(row_key("i", "t").alias("k")).collect()
    assert all(len(r.k) == 16 for r in rows) and len({bytes(r.k) for r in rows}) == 4


def test_one_operator_remembers_at_a_time():
    gone = []
    for name in ("a", "a", "b", "a"):
        holding(name, lambda name=name: gone.append(name))
    assert gone == ["a", "b"]
    holding("", lambda: None)


def test_workers_forget_other_operators(spark):
    """In a worker, too: what it runs is a copy of the operator's code, what remembers is the module."""
    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tidemark.llm.jaccard_join import jaccard_groups
    from tidemark.llm.piece_dropout import encode_docs

    def left(batches):
        from tidemark.llm import common, jaccard_join, piece_dropout

        common.holding("another", lambda: None)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(piece_dropout._loaded) + len(jaccard_join._hashes.known)] * b.num_rows, pa.int32())], ["n"])

    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(40)], "doc_id long, text string").repartition(8)
    ask = spark.range(400).repartition(16)
    for out in (encode_docs(docs, public_tokenizers.path("piece_bpe_32k.model")), jaccard_groups(docs)):
        out.write.format("noop").mode("overwrite").save()
        assert ask.mapInArrow(left, "n int").agg(F.max("n")).first()[0] == 0
    clear(spark)


def test_idle_workers_forget(monkeypatch):
    import time

    from tidemark.llm import common

    monkeypatch.setattr(common, "IDLE_SECONDS", 0.2)
    gone = []
    holding("a", lambda: gone.append("a"))
    common.give_back()
    holding("a", lambda: gone.append("a"))  # busy again
    time.sleep(0.5)
    assert gone == []
    common.give_back()
    time.sleep(0.5)
    assert gone == ["a"]

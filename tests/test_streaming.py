import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import frame, walk
from tidemark.operators import CATALOG, indicator
from tidemark.plans import with_indicators
from tidemark.streaming import STATE_STORE, bar_stream, stream_indicators


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.unset(STATE_STORE[0])


def run(df, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    """Three micro-batches of two series, all operators."""
    inds = [indicator(n) for n in CATALOG if n != "ecl" and n not in ("vegas", "adosc", "ha")] + [indicator(n) for n in ("adosc", "ha")]
    bars = frame(spark, {"a": walk(120, 1), "b": walk(90, 2)})
    for k, (lo, hi) in enumerate([(0, 40), (40, 41), (41, 200)]):
        bars.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(stream_indicators(files, inds), spark, "streamed").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = with_indicators(bars, inds).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and len(got) == 210
    for c in want.columns:
        if want[c].dtype == object:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
        else:
            pd.testing.assert_series_equal(got[c], want[c], check_dtype=False, rtol=1e-6, atol=1e-6)


def test_late_bars_are_left_out(spark, tmp_path):
    bars = frame(spark, {"a": walk(30, 1)})
    bars.where("ts >= 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    bars.where("ts < 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r.ts for r in run(stream_indicators(files, [indicator("sma")]), spark, "late").collect())[0] >= 10


def test_bars_of_a_stream(spark, tmp_path):
    ticks = spark.range(500).select(
        F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("time"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("sym"), (100 + F.sin("id")).alias("price"), F.lit(1.0).alias("size")
    )
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    ticks.limit(1).withColumn("time", F.timestamp_seconds(F.lit(10**6))).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    out = run(bar_stream(stream, "sym", "time", "price", "size", "id"), spark, "bars_out").where("ts < timestamp_seconds(100000)").collect()
    assert len(out) == 2 * 9 and sum(r.volume for r in out) == 500 and all(r.low <= r.open <= r.high for r in out)

"""OHLCV bars from ticks: one hash aggregation with partial results, no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(ticks: DataFrame, symbol: Column, bar: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """``order`` must tell apart any two ticks of a bar: the first opens it, the last closes it."""
    at = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    rows = ticks.select(symbol.alias("symbol"), bar.alias("ts"), price.cast("double").alias("p"), volume.cast("double").alias("v"), at.alias("at"))
    return (
        rows.where(F.col("p").isNotNull() & F.col("ts").isNotNull())
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
            F.max_by("p", "at").alias("close"), F.sum("v").alias("volume"),
        )
    )


def _day(column: str) -> Column:
    return F.date_format(F.to_timestamp(column), "yyyy-MM-dd")


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each return flag and line status, a bar for each ship date."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return bars(t, F.concat("l_returnflag", "l_linestatus"), _day("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), [F.col(c) for c in _ORDER])


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each supplier."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [F.col(c) for c in [*_ORDER, "l_returnflag", "l_linestatus", "l_quantity"]]
    return bars(t, F.col("l_suppkey").cast("string"), _day("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), order)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each event type, a bar for each hour."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")
    return bars(t, F.col("event_type"), hour, F.col("value"), F.lit(1.0), [F.col("ts"), F.col("event_id")])


def aligned(bars: DataFrame, first: str, second: str, column: str = "close") -> DataFrame:
    """Two series of the bars side by side, at the times that both have, for operators on pairs: symbol
    ("first/second"), ts, price, price2. Each side is filtered before the join."""
    left, right = (bars.where(F.col("symbol") == s).select("ts", F.col(column).alias(n)) for s, n in ((first, "price"), (second, "price2")))
    return left.join(right, "ts").select(F.lit(f"{first}/{second}").alias("symbol"), "ts", "price", "price2")

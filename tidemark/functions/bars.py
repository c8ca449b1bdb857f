"""Lengths of a candle's parts, gaps between candles, and the age of extremes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.options import Series


def period_to_k(period: int) -> float:
    """The smoothing factor of an exponential average."""
    return 2.0 / (period + 1)


def real_body(open_: Column, close: Column) -> Column:
    return F.abs(close - open_)


def upper_shadow(high: Column, open_: Column, close: Column) -> Column:
    return high - F.greatest(open_, close)


def lower_shadow(low: Column, open_: Column, close: Column) -> Column:
    return F.least(open_, close) - low


def gap_up(open_: Column, close: Column, prev_open: Column, prev_close: Column) -> Column:
    """The body lies above the one before it."""
    return F.least(open_, close) > F.greatest(prev_open, prev_close)


def gap_down(open_: Column, close: Column, prev_open: Column, prev_close: Column) -> Column:
    return F.greatest(open_, close) < F.least(prev_open, prev_close)


def highest_bars(value: Column, number: Column, series: Series, length: int) -> Column:
    """Bars since the highest of the last ``length`` values, the latest of equals. ``number``: of the bar."""
    w = Window.partitionBy(*series.keys).orderBy(series.order).rowsBetween(1 - length, 0)
    return number - F.max(F.struct(value.alias("v"), number.alias("n"))).over(w)["n"]


def lowest_bars(value: Column, number: Column, series: Series, length: int) -> Column:
    w = Window.partitionBy(*series.keys).orderBy(series.order).rowsBetween(1 - length, 0)
    return number + F.min(F.struct(value.alias("v"), (-number).alias("n"))).over(w)["n"]

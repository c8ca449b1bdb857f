"""The operators."""

from tidemark.operators.averages import Average, moving_average
from tidemark.operators.catalog import CATALOG, indicator, lookback

__all__ = ["CATALOG", "Average", "indicator", "lookback", "moving_average"]

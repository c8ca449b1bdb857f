"""Indicators over tables, from Python and from SQL."""

from tidemark.plans.batch import with_indicators

__all__ = ["with_indicators"]

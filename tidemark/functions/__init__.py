"""Scalar helpers of bars, as columns."""

from tidemark.functions.bars import (
    gap_down,
    gap_up,
    highest_bars,
    lower_shadow,
    lowest_bars,
    period_to_k,
    real_body,
    upper_shadow,
)

__all__ = ["gap_down", "gap_up", "highest_bars", "lower_shadow", "lowest_bars", "period_to_k", "real_body", "upper_shadow"]

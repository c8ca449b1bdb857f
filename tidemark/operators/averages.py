"""Moving averages by kind."""

from __future__ import annotations

from enum import IntEnum
from typing import Any

from tidemark.operators.catalog import Indicator, indicator


class Average(IntEnum):
    """The numbers of the kinds. KAMA and MAMA are named, but no operator computes them."""

    DEMA = 0
    EMA = 1
    KAMA = 2
    MAMA = 3
    RMA = 4
    SMA = 5
    T3 = 6
    TEMA = 7
    TRIMA = 8
    WMA = 9


def moving_average(kind: Average | int | str = Average.SMA, prefix: str | None = None, inputs: dict[str, str] | None = None, **params: Any) -> Indicator:
    kind = Average[kind.upper()] if isinstance(kind, str) else Average(kind)
    return indicator(kind.name.lower(), prefix, inputs, **params)

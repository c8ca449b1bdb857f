"""How a series is found in a table, and what holds for a whole computation."""

from __future__ import annotations

from dataclasses import dataclass, field

EPSILON = 2.220446049250313e-16

#: Signals that operators emit.
BULLISH, BALANCE, BEARISH, NEUTRAL, PATTERN, INVALID = 100, 50, -100, 0, 1, -1


@dataclass(frozen=True)
class Series:
    """``keys`` tell series apart, ``order`` puts a series' rows in order and must be unique within it."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "ts"
    roles: dict[str, str] = field(default_factory=dict)

    def column(self, role: str) -> str:
        return self.roles.get(role, role)


@dataclass(frozen=True)
class Options:
    """``warmup``: what stands where an operator has no value yet, "null" or "nan". ``precision``: "double"
    or "single" (floats and ints in the results). ``check_nan``: refuse inputs with NaN. ``strict``: refuse
    series that are too short for an operator. The last two each read the input once more."""

    warmup: str = "null"
    precision: str = "double"
    check_nan: bool = False
    strict: bool = False

    def __post_init__(self) -> None:
        if self.warmup not in ("null", "nan"):
            raise ValueError("warmup is 'null' or 'nan'")
        if self.precision not in ("double", "single"):
            raise ValueError("precision is 'double' or 'single'")

"""The operators: what each needs, takes, checks and returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Kinds of parameters: a whole number of bars of at least so many, or a number over 0.
Checks = dict[str, Callable[[Any], bool]]


def at_least(n: int) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= n


def positive(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x > 0


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass(frozen=True)
class Operator:
    """``kind``: "row" (the row alone), "window" (a bounded frame), "running" (sums from the start) or
    "recursive" (its own last output). ``outputs``: name and type, the main one first."""

    name: str
    kind: str
    roles: tuple[str, ...]
    params: Checks
    lookback: Callable[..., int]
    outputs: tuple[tuple[str, str], ...]
    defaults: dict[str, Any] = field(default_factory=dict)
    relation: Callable[[dict[str, Any]], str | None] = lambda p: None
    optional: tuple[str, ...] = ()

    def checked(self, given: dict[str, Any]) -> dict[str, Any]:
        unknown = given.keys() - self.params.keys()
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        out = self.defaults | given
        for name, check in self.params.items():
            if name not in out or (out[name] is None and name in self.optional):
                if name in self.optional:
                    out[name] = None
                    continue
                raise ValueError(f"{self.name} needs {name}")
            if not check(out[name]):
                raise ValueError(f"{self.name}: {name}={out[name]!r} is out of range")
        if fault := self.relation(out):
            raise ValueError(f"{self.name}: {fault}")
        return out


CATALOG: dict[str, Operator] = {}


def _add(name: str, kind: str, roles: str, params: Checks, lookback: Callable[..., int], outputs: str, defaults: dict[str, Any], **more: Any) -> None:
    """``outputs``: names; a colon and a type follow where it isn't double."""
    outs = tuple((o.split(":")[0], o.split(":")[1] if ":" in o else "double") for o in outputs.split())
    CATALOG[name] = Operator(name, kind, tuple(roles.split()), params, lookback, outs, defaults, **more)


_P = {"period": at_least(2)}
_P1 = {"period": at_least(1)}
_14 = {"period": 14}


def _less(a: str, b: str) -> Callable[[dict[str, Any]], str | None]:
    return lambda p: None if p[a] < p[b] else f"{a} must be less than {b}"


_less_one = lambda period, **_: period - 1
_same = lambda period, **_: period
_none = lambda **_: 0

# moving averages
_add("sma", "window", "price", _P, _less_one, "sma", _14)
_add("ema", "recursive", "price", _P | {"k": positive}, _less_one, "ema", _14 | {"k": None}, optional=("k",))
_add("rma", "recursive", "price", _P, _less_one, "rma", _14)
_add("wma", "window", "price", _P, _less_one, "wma", {"period": 30})
_add("dema", "recursive", "price", _P, lambda period: 2 * (period - 1), "dema ema1 ema2", {"period": 5})
_add("tema", "recursive", "price", _P, lambda period: 3 * (period - 1), "tema ema1 ema2 ema3", {"period": 3})
_add("t3", "recursive", "price", _P | {"vfactor": number}, lambda period, **_: 6 * (period - 1), "t3 ema1 ema2 ema3 ema4 ema5 ema6", {"period": 5, "vfactor": 0.7})
_add("trima", "window", "price", _P, _less_one, "trima sma1", {"period": 30})
# momentum
_add("macd", "recursive", "price", {"fast_period": at_least(2), "slow_period": at_least(2), "signal_period": at_least(2)}, lambda slow_period, signal_period, **_: slow_period + signal_period - 2, "macd_line signal histogram fast_ema slow_ema", {"fast_period": 12, "slow_period": 26, "signal_period": 9}, relation=_less("fast_period", "slow_period"))
_add("rsi", "recursive", "price", _P, _same, "rsi avg_gain avg_loss", _14)
_add("mom", "window", "price", _P, _same, "mom", _14)
_add("roc", "window", "price", _P1, _same, "roc", _14)
_add("rocp", "window", "price", _P1, _same, "rocp", {"period": 10})
_add("rocr", "window", "price", _P, _same, "rocr", {"period": 10})
_add("rocr100", "window", "price", _P, _same, "rocr100", {"period": 10})
_add("trix", "recursive", "price", _P, lambda period: 3 * (period - 1) + 1, "trix ema1 ema2 ema3", {"period": 3})
_add("cci", "window", "high low close", _P, _less_one, "cci tp tp_sma mean_dev", _14)
_add("mfi", "window", "high low close volume", _P, _same, "mfi typ_price money_flow pos_flow neg_flow", _14)
_add("stoch", "window", "high low close", {"k_period": at_least(2), "k_slow_period": at_least(2), "d_period": at_least(2)}, lambda k_period, k_slow_period, d_period: k_period + k_slow_period + d_period - 3, "fast_k k d", {"k_period": 14, "k_slow_period": 3, "d_period": 3})
_add("willr", "window", "high low close", _P, _less_one, "willr highest_high lowest_low", _14)
_add("bop", "row", "open high low close", {}, _none, "bop", {})
# direction
_add("plus_dm", "recursive", "high low", _P, _less_one, "plus_dm", _14)
_add("minus_dm", "recursive", "high low", _P, _less_one, "minus_dm", _14)
_add("plus_di", "recursive", "high low close", _P, _same, "plus_di smoothed_plus_dm smoothed_tr", _14)
_add("minus_di", "recursive", "high low close", _P, _same, "minus_di smoothed_minus_dm smoothed_tr", _14)
_add("dx", "recursive", "high low close", _P, _same, "dx smoothed_plus_dm smoothed_minus_dm smoothed_tr", _14)
_add("adx", "recursive", "high low close", _P, lambda period: 2 * period - 1, "adx smoothed_plus_dm smoothed_minus_dm smoothed_tr", _14)
_add("adxr", "recursive", "high low close", _P, lambda period: 3 * period - 2, "adxr adx smoothed_plus_dm smoothed_minus_dm smoothed_tr", _14)
_add("aroon", "window", "high low", _P, _same, "aroon_up aroon_down prev_high prev_low days_since_high:bigint days_since_low:bigint", _14)
_add("aroonosc", "window", "high low", _P, _same, "aroonosc prev_high prev_low days_since_high:bigint days_since_low:bigint", _14)
# volatility, bands, stops
_add("trange", "window", "high low close", {}, lambda: 1, "trange", {})
_add("atr", "recursive", "high low close", _P, _same, "atr", _14)
_add("natr", "recursive", "high low close", _P, _same, "natr", _14)
_add("bbands", "window", "price", _P | {"dev_up": positive, "dev_down": positive}, lambda period, **_: period - 1, "upper middle lower var sum sum_sq", {"period": 20, "dev_up": 2.0, "dev_down": 2.0})
_add("adr", "window", "high low", _P, _less_one, "adr", {"period": 3})
_add("sar", "recursive", "high low", {"acceleration": positive, "maximum": positive}, lambda **_: 1, "sar is_long:boolean af ep", {"acceleration": 0.02, "maximum": 0.2}, relation=_less("acceleration", "maximum"))
_add("supertrend", "recursive", "high low close", _P | {"multiplier": positive}, lambda period, **_: period, "supertrend trend:bigint atr upper lower", {"period": 10, "multiplier": 3.0})
# volume
_add("ad", "running", "high low close volume", {}, _none, "ad", {})
_add("adosc", "recursive", "high low close volume", {"fast_period": at_least(2), "slow_period": at_least(2)}, lambda slow_period, **_: slow_period - 1, "adosc ad fast_ema slow_ema", {"fast_period": 3, "slow_period": 10}, relation=_less("fast_period", "slow_period"))
_add("obv", "running", "close volume", {}, _none, "obv", {})
_add("vwap", "running", "high low close volume", {}, _none, "vwap cum_pv cum_vol", {})
# price transforms and levels
_add("medprice", "row", "high low", {}, _none, "medprice", {})
_add("typprice", "row", "high low close", {}, _none, "typprice", {})
_add("wclprice", "row", "high low close", {}, _none, "wclprice", {})
_add("midpoint", "window", "price", _P, _less_one, "midpoint highest lowest", _14)
_add("midprice", "window", "high low", _P, _less_one, "midprice highest_high lowest_low", _14)
_add("ha", "recursive", "open high low close", {}, lambda: 1, "ha_open ha_high ha_low ha_close", {})
_add("ecl", "window", "high low close", {}, lambda: 1, "h5 h4 h3 h2 h1 l1 l2 l3 l4 l5", {})
_add("vegas", "recursive", "price", {}, lambda: 675, "channel_upper channel_lower boundary_upper boundary_lower", {})
# candlestick patterns
_add("cdl_doji", "row", "open high low close", {"body_percent": positive, "shadow_equal_percent": positive}, _none, "signal:bigint", {"body_percent": 5.0, "shadow_equal_percent": 100.0})
_add("cdl_dragonfly_doji", "row", "open high low close", {"body_percent": positive}, _none, "signal:bigint", {"body_percent": 5.0})
_add("cdl_gravestone_doji", "row", "open high low close", {"body_percent": number}, _none, "signal:bigint", {"body_percent": 5.0})
_add("cdl_hammer", "recursive", "open high low close", _P | {"factor": positive}, lambda period, **_: period - 1, "signal:bigint body_avg", {"period": 14, "factor": 2.0})
_add("cdl_inverted_hammer", "recursive", "open high low close", _P | {"factor": positive}, lambda period, **_: period - 1, "signal:bigint body_avg", {"period": 14, "factor": 2.0})
_add("cdl_long_shadow", "recursive", "open high low close", _P | {"shadow_factor": positive}, lambda period, **_: period - 1, "signal:bigint body_avg", {"period": 14, "shadow_factor": 75.0})
_add("cdl_marubozu", "recursive", "open high low close", _P | {"shadow_percent": positive}, lambda period, **_: period - 1, "signal:bigint body_avg", {"period": 14, "shadow_percent": 5.0})
# rolling statistics
_add("max", "window", "price", _P, _less_one, "max", _14)
_add("min", "window", "price", _P, _less_one, "min", _14)
_add("sum", "window", "price", _P, _less_one, "sum", _14)
_add("var", "window", "price", _P, _less_one, "var sum sum_sq", _14)
_add("stddev", "window", "price", _P, _less_one, "stddev sum sum_sq", _14)
_add("correl", "window", "price price2", _P, _less_one, "correl sum_0 sum_1 sum_0_sq sum_1_sq sum_01", _14)


def lookback(name: str, **params: Any) -> int:
    """Index of the first bar with a value."""
    op = CATALOG[name]
    return op.lookback(**{k: v for k, v in op.checked(params).items()})


@dataclass(frozen=True)
class Indicator:
    """An operator with its parameters, the columns it reads and a prefix for those it adds."""

    operator: Operator
    params: dict[str, Any]
    inputs: dict[str, str]
    prefix: str

    def columns(self) -> list[tuple[str, str]]:
        return [(f"{self.prefix}_{n}", t) for n, t in self.operator.outputs]


def indicator(name: str, prefix: str | None = None, inputs: dict[str, str] | None = None, **params: Any) -> Indicator:
    """``inputs``: columns by role (price, price2, open, high, low, close, volume); the price is close
    unless told otherwise."""
    if name not in CATALOG:
        raise ValueError(f"there is no operator {name}")
    op = CATALOG[name]
    unknown = (inputs or {}).keys() - set(op.roles)
    if unknown:
        raise ValueError(f"{name} reads no {', '.join(sorted(unknown))}")
    roles = {r: {"price": "close", "price2": "volume"}.get(r, r) for r in op.roles} | (inputs or {})
    return Indicator(op, op.checked(params), roles, prefix or name)

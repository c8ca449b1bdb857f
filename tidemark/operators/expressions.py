"""Row, window and running operators as columns: no Python touches the data.

A window function cannot stand inside another, so an operator is written in steps: ``let`` names an
intermediate column at a depth, and all operators' columns of one depth are added together, over one
partitioning and order. A frame gives a value only when it is full and free of nulls. A frame is summed up
again for every row, so those of more than LONGEST_FRAME bars go with the recursive operators instead
(``plans/batch.py``), as do the two that need every value of their frame (wma, cci).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import lower_shadow, real_body, upper_shadow
from tidemark.options import BEARISH, BULLISH, NEUTRAL, PATTERN, Series

Out = dict[str, Column]
LONGEST_FRAME = 32


class Steps:
    """Intermediate columns by depth, shared by all operators that ask for the same."""

    def __init__(self, series: Series):
        self.series = series
        self.columns: dict[str, tuple[int, Column]] = {}
        self.names: dict[str, str] = {}

    def let(self, what: str, column: Callable[[], Column] | Column, depth: int = 0) -> Column:
        """``what``: a text that says all about the column."""
        name = self.names.setdefault(what, f"__t{len(self.names)}")
        if name not in self.columns:
            self.columns[name] = (depth, column() if callable(column) else column)
        return F.col(name)

    def at(self, depth: int) -> dict[str, Column]:
        return {n: c for n, (d, c) in self.columns.items() if d == depth}

    @property
    def deepest(self) -> int:
        return max((d for d, _ in self.columns.values()), default=-1)

    def order(self):  # noqa: ANN201
        return Window.partitionBy(*self.series.keys).orderBy(self.series.order)

    def frame(self, n: int):  # noqa: ANN201
        return self.order().rowsBetween(1 - n, 0)

    def all(self):  # noqa: ANN201
        return self.order().rowsBetween(Window.unboundedPreceding, 0)


class Bars:
    """What a builder sees: its columns, windows and helpers."""

    def __init__(self, steps: Steps, inputs: dict[str, str]):
        self.steps, self.inputs = steps, inputs

    def __getattr__(self, role: str) -> Column:
        name = self.inputs[role]
        x = F.col(f"`{name}`").cast("double")
        return self.steps.let(f"in {name}", lambda: F.when(~F.isnan(x), x), 0)

    def name(self, role: str) -> str:
        return self.inputs[role]

    def number(self) -> Column:
        return self.steps.let("number", lambda: F.row_number().over(self.steps.order()).cast("bigint"), 0)

    def lag(self, role: str, n: int = 1) -> Column:
        x = getattr(self, role)
        return self.steps.let(f"lag {n} {self.name(role)}", lambda: F.lag(x, n).over(self.steps.order()), 1)

    def over(self, how: str, x: Column, what: str, n: int, depth: int) -> Column:
        """An aggregate over the last n bars, null unless all n have a value."""
        w = self.steps.frame(n)
        full = F.count(x).over(w) == n
        return self.steps.let(f"{how} {n} {what}", lambda: F.when(full, getattr(F, how)(x).over(w)), depth)


    def running(self, x: Column, what: str, depth: int) -> Column:
        """The sum from the start, null from the first null on, as a recurrence has no value after one."""
        w = self.steps.all()
        whole = F.count(x).over(w) == F.count(F.lit(1)).over(w)
        return self.steps.let(f"running {what}", lambda: F.when(whole, F.sum(x).over(w)), depth)


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _sma(b: Bars, period: int) -> Out:
    return {"sma": b.over("avg", b.price, b.name("price"), period, 1)}


def _trima(b: Bars, period: int) -> Out:
    n, m = ((period + 1) // 2,) * 2 if period % 2 else (period // 2 + 1, period // 2)
    first = b.over("avg", b.price, b.name("price"), n, 1)
    second = b.over("avg", first, f"sma {n} {b.name('price')}", m, 2)
    return {"trima": second, "sma1": F.when(second.isNotNull(), first)}


def _mom(b: Bars, period: int) -> Out:
    return {"mom": b.price - b.lag("price", period)}


def _roc(b: Bars, period: int) -> Out:
    p = b.lag("price", period)
    return {"roc": _div(b.price - p, p) * 100.0}


def _rocp(b: Bars, period: int) -> Out:
    p = b.lag("price", period)
    return {"rocp": _div(b.price - p, p)}


def _rocr(b: Bars, period: int) -> Out:
    return {"rocr": _div(b.price, b.lag("price", period))}


def _rocr100(b: Bars, period: int) -> Out:
    return {"rocr100": _div(b.price, b.lag("price", period)) * 100.0}


def _tp(b: Bars) -> tuple[Column, str]:
    what = f"tp {b.name('high')} {b.name('low')} {b.name('close')}"
    return b.steps.let(what, (b.high + b.low + b.close) / 3.0, 1), what


def _mfi(b: Bars, period: int) -> Out:
    tp, what = _tp(b)
    before = b.steps.let(f"lag {what}", lambda: F.lag(tp).over(b.steps.order()), 2)
    flow = tp * b.volume
    known = before.isNotNull() & flow.isNotNull()
    pos = b.steps.let(f"pos {what} {b.name('volume')}", F.when(known, F.when(tp > before, flow).otherwise(0.0)), 3)
    neg = b.steps.let(f"neg {what} {b.name('volume')}", F.when(known, F.when(tp < before, flow).otherwise(0.0)), 3)
    p = b.over("sum", pos, f"pos {what} {b.name('volume')}", period, 4)
    n = b.over("sum", neg, f"neg {what} {b.name('volume')}", period, 4)
    total = p + n
    return {
        "mfi": F.when(total < 1.0, 0.0).otherwise(100.0 * (p / F.nullif(total, F.lit(0.0)))),
        "typ_price": F.when(total.isNotNull(), tp), "money_flow": F.when(total.isNotNull(), flow), "pos_flow": p, "neg_flow": n,
    }


def _extremes(b: Bars, period: int, high: str = "high", low: str = "low") -> tuple[Column, Column]:
    return (
        b.over("max", getattr(b, high), b.name(high), period, 1),
        b.over("min", getattr(b, low), b.name(low), period, 1),
    )


def _stoch(b: Bars, k_period: int, k_slow_period: int, d_period: int) -> Out:
    top, bottom = _extremes(b, k_period)
    span = top - bottom
    fast = F.when(span > 0, 100.0 * (b.close - bottom) / F.nullif(span, F.lit(0.0))).when(span.isNotNull() & b.close.isNotNull(), 50.0)
    what = f"fast_k {k_period} {b.name('high')} {b.name('low')} {b.name('close')}"
    fast = b.steps.let(what, fast, 2)
    k = b.over("avg", fast, what, k_slow_period, 3)
    d = b.over("avg", k, f"{what} {k_slow_period}", d_period, 4)
    return {"fast_k": F.when(d.isNotNull(), fast), "k": F.when(d.isNotNull(), k), "d": d}


def _willr(b: Bars, period: int) -> Out:
    top, bottom = _extremes(b, period)
    span = top - bottom
    value = F.when(span == 0, 0.0).otherwise(-100.0 * (top - b.close) / F.nullif(span, F.lit(0.0)))
    return {"willr": value, "highest_high": top, "lowest_low": bottom}


def _bop(b: Bars) -> Out:
    span = b.high - b.low
    return {"bop": F.when(span == 0, 0.0).otherwise(_div(b.close - b.open, span))}


def _ages(b: Bars, period: int) -> tuple[Column, Column, Column, Column]:
    w, n = b.steps.frame(period + 1), b.number()
    h, low = b.high, b.low
    full = (F.count(h).over(w) == period + 1) & (F.count(low).over(w) == period + 1)
    key = f"{period} {b.name('high')} {b.name('low')}"
    top = b.steps.let(f"top {key}", lambda: F.when(full, F.max(F.struct(h.alias("v"), n.alias("n"))).over(w)), 1)
    bottom = b.steps.let(f"bottom {key}", lambda: F.when(full, F.min(F.struct(low.alias("v"), (-n).alias("n"))).over(w)), 1)
    return top["v"], bottom["v"], n - top["n"], n + bottom["n"]


def _aroon(b: Bars, period: int) -> Out:
    high, low, since_high, since_low = _ages(b, period)
    up, down = (100.0 - 100.0 * s / float(period) for s in (since_high, since_low))
    zero = F.lit(0).cast("bigint")
    return {"aroon_up": up, "aroon_down": down, "prev_high": high, "prev_low": low, "days_since_high": F.coalesce(since_high, zero), "days_since_low": F.coalesce(since_low, zero)}


def _aroonosc(b: Bars, period: int) -> Out:
    out = _aroon(b, period)
    return {"aroonosc": out.pop("aroon_up") - out.pop("aroon_down")} | out


def true_range(b: Bars) -> Column:
    before = b.lag("close")
    return F.when(before.isNotNull() & b.high.isNotNull() & b.low.isNotNull(), F.greatest(b.high - b.low, F.abs(b.high - before), F.abs(b.low - before)))


def _trange(b: Bars) -> Out:
    return {"trange": true_range(b)}


def _moments(b: Bars, period: int) -> tuple[Column, Column, Column]:
    x, what = b.price, b.name("price")
    return (
        b.over("var_pop", x, what, period, 1),
        b.over("sum", x, what, period, 1),
        b.over("sum", x * x, f"square {what}", period, 1),
    )


def _bbands(b: Bars, period: int, dev_up: float, dev_down: float) -> Out:
    var, total, squares = _moments(b, period)
    mid = b.over("avg", b.price, b.name("price"), period, 1)
    dev = F.sqrt(var)
    return {"upper": mid + dev_up * dev, "middle": mid, "lower": mid - dev_down * dev, "var": var, "sum": total, "sum_sq": squares}


def _adr(b: Bars, period: int) -> Out:
    return {"adr": b.over("avg", b.high - b.low, f"span {b.name('high')} {b.name('low')}", period, 1)}


def money_flow_volume(b: Bars) -> Column:
    span = b.high - b.low
    return F.when(span == 0, 0.0).otherwise(_div((b.close - b.low) - (b.high - b.close), span) * b.volume)


def _ad(b: Bars) -> Out:
    return {"ad": b.running(money_flow_volume(b), " ".join(["ad", *map(b.name, ("high", "low", "close", "volume"))]), 1)}


def _obv(b: Bars) -> Out:
    before, v = b.lag("close"), b.volume
    step = F.when(b.number() == 1, v).when(b.close > before, v).when(b.close < before, -v).otherwise(0.0)
    what = f"obv {b.name('close')} {b.name('volume')}"
    step = b.steps.let(what, F.when(b.close.isNotNull() & v.isNotNull(), step), 2)
    return {"obv": b.running(step, what, 3)}


def _vwap(b: Bars) -> Out:
    tp, what = _tp(b)
    pv, volume = b.running(tp * b.volume, f"pv {what} {b.name('volume')}", 2), b.running(b.volume, f"volume {b.name('volume')}", 2)
    return {"vwap": F.when(volume == 0, 0.0).otherwise(_div(pv, volume)), "cum_pv": pv, "cum_vol": volume}


def _medprice(b: Bars) -> Out:
    return {"medprice": (b.high + b.low) / 2.0}


def _typprice(b: Bars) -> Out:
    return {"typprice": (b.high + b.low + b.close) / 3.0}


def _wclprice(b: Bars) -> Out:
    return {"wclprice": (b.high + b.low + b.close * 2.0) / 4.0}


def _midpoint(b: Bars, period: int) -> Out:
    top, bottom = _extremes(b, period, "price", "price")
    return {"midpoint": (top + bottom) / 2.0, "highest": top, "lowest": bottom}


def _midprice(b: Bars, period: int) -> Out:
    top, bottom = _extremes(b, period)
    return {"midprice": (top + bottom) / 2.0, "highest_high": top, "lowest_low": bottom}


def _ecl(b: Bars) -> Out:
    h, low, c = b.lag("high"), b.lag("low"), b.lag("close")
    span = h - low
    count = b.steps.let("count", lambda: F.count(F.lit(1)).over(Window.partitionBy(*b.steps.series.keys)), 1)
    enough = count >= 3
    h5 = _div(h, low) * c
    out = {"h5": h5}
    for n, part in ((4, 2.0), (3, 4.0), (2, 6.0), (1, 12.0)):
        out[f"h{n}"] = c + span * 1.1 / part
    for n, part in ((1, 12.0), (2, 6.0), (3, 4.0), (4, 2.0)):
        out[f"l{n}"] = c - span * 1.1 / part
    out["l5"] = c - (h5 - c)
    return {k: F.when(enough, v) for k, v in out.items()}


def _small_body(b: Bars, percent: float) -> tuple[Column, Column]:
    body, span = real_body(b.open, b.close), b.high - b.low
    return body, (span > 0) & (body <= span * percent / 100.0)


def _flag(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(NEUTRAL).cast("bigint")


def _doji(b: Bars, body_percent: float, shadow_equal_percent: float) -> Out:
    _, small = _small_body(b, body_percent)
    up, down = upper_shadow(b.high, b.open, b.close), lower_shadow(b.low, b.open, b.close)
    differ = F.least(_div(F.abs(up - down), down) * 100.0, _div(F.abs(down - up), up) * 100.0)
    differ = F.when((down > 0) & (up > 0), differ).otherwise(100.0)
    return {"signal": _flag(small & (differ < shadow_equal_percent), PATTERN)}


def _dragonfly(b: Bars, body_percent: float) -> Out:
    body, small = _small_body(b, body_percent)
    return {"signal": _flag(small & (upper_shadow(b.high, b.open, b.close) <= body), BULLISH)}


def _gravestone(b: Bars, body_percent: float) -> Out:
    body, small = _small_body(b, body_percent)
    return {"signal": _flag(small & (lower_shadow(b.low, b.open, b.close) <= body), BEARISH)}


def _rolling(how: str) -> Callable[..., Out]:
    return lambda b, period: {how: b.over(how, b.price, b.name("price"), period, 1)}


def _var(b: Bars, period: int) -> Out:
    var, total, squares = _moments(b, period)
    return {"var": var, "sum": total, "sum_sq": squares}


def _stddev(b: Bars, period: int) -> Out:
    var, total, squares = _moments(b, period)
    return {"stddev": F.sqrt(var), "sum": total, "sum_sq": squares}


def _correl(b: Bars, period: int) -> Out:
    x, y = b.price, b.price2
    both = x.isNotNull() & y.isNotNull()
    x, y, w = F.when(both, x), F.when(both, y), b.steps.frame(period)
    key = f"{b.name('price')} {b.name('price2')}"
    full = F.count(x).over(w) == period
    parts = {
        n: b.steps.let(f"{n} {period} {key}", F.when(full, f), 1)
        for n, f in {
            "cov": F.covar_pop(x, y).over(w), "sx": F.stddev_pop(x).over(w), "sy": F.stddev_pop(y).over(w),
            "sum_0": F.sum(x).over(w), "sum_1": F.sum(y).over(w), "sum_0_sq": F.sum(x * x).over(w), "sum_1_sq": F.sum(y * y).over(w), "sum_01": F.sum(x * y).over(w),
        }.items()
    }
    return {"correl": _div(parts["cov"], parts["sx"] * parts["sy"])} | {n: parts[n] for n in ("sum_0", "sum_1", "sum_0_sq", "sum_1_sq", "sum_01")}


BUILDERS: dict[str, Callable[..., Out]] = {
    "sma": _sma, "trima": _trima, "mom": _mom, "roc": _roc, "rocp": _rocp, "rocr": _rocr, "rocr100": _rocr100,
    "mfi": _mfi, "stoch": _stoch, "willr": _willr, "bop": _bop, "aroon": _aroon, "aroonosc": _aroonosc,
    "trange": _trange, "bbands": _bbands, "adr": _adr, "ad": _ad, "obv": _obv, "vwap": _vwap, "medprice": _medprice,
    "typprice": _typprice, "wclprice": _wclprice, "midpoint": _midpoint, "midprice": _midprice, "ecl": _ecl,
    "cdl_doji": _doji, "cdl_dragonfly_doji": _dragonfly, "cdl_gravestone_doji": _gravestone,
    "max": _rolling("max"), "min": _rolling("min"), "sum": _rolling("sum"), "var": _var, "stddev": _stddev, "correl": _correl,
}


def build(steps: Steps, name: str, inputs: dict[str, str], params: dict[str, Any]) -> Out:
    return BUILDERS[name](Bars(steps, inputs), **params)

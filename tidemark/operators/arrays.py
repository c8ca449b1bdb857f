"""Row, window and running operators over one series in order, a chunk at a time, for streams and for
frames too long to be columns.

A window operator keeps the bars that its next value looks back on; running ones keep their sums.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from tidemark.operators import kernels as K
from tidemark.operators.catalog import CATALOG
from tidemark.options import BEARISH, BULLISH, NEUTRAL, PATTERN

Arrays = K.Arrays


def _roll(x: np.ndarray, n: int, how: Callable[..., np.ndarray]) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = how(sliding_window_view(x, n), axis=1)
    return out


def _lag(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) > n:
        out[n:] = x[:-n]
    return out


def _trima(x: Arrays, period: int) -> Arrays:
    n, m = ((period + 1) // 2,) * 2 if period % 2 else (period // 2 + 1, period // 2)
    first = _roll(x["price"], n, np.mean)
    second = _roll(first, m, np.mean)
    return {"trima": second, "sma1": np.where(np.isnan(second), np.nan, first)}


def _change(x: Arrays, period: int) -> tuple[np.ndarray, np.ndarray]:
    before = _lag(x["price"], period)
    return x["price"], np.where(before == 0, np.nan, before)


def _typical(x: Arrays) -> np.ndarray:
    return (x["high"] + x["low"] + x["close"]) / 3.0


def _cci(x: Arrays, period: int) -> Arrays:
    tp = _typical(x)
    mean = _roll(tp, period, np.mean)
    dev = _roll(tp, period, lambda w, axis: np.abs(w - w.mean(axis=axis, keepdims=True)).mean(axis=axis))
    return {"cci": np.where(dev == 0, 0.0, (tp - mean) / (dev * 0.015)), "tp": np.where(np.isnan(mean), np.nan, tp), "tp_sma": mean, "mean_dev": dev}


def _mfi(x: Arrays, period: int) -> Arrays:
    tp = _typical(x)
    before, flow = _lag(tp), tp * x["volume"]
    none = (before + flow) * 0
    pos, neg = (_roll(np.where(c, flow, none), period, np.sum) for c in (tp > before, tp < before))
    total = pos + neg
    gone = np.isnan(total)
    return {"mfi": np.where(gone, np.nan, np.where(total < 1.0, 0.0, 100.0 * (pos / total))), "typ_price": np.where(gone, np.nan, tp), "money_flow": np.where(gone, np.nan, flow), "pos_flow": pos, "neg_flow": neg}


def _stoch(x: Arrays, k_period: int, k_slow_period: int, d_period: int) -> Arrays:
    top, bottom = _roll(x["high"], k_period, np.max), _roll(x["low"], k_period, np.min)
    span = top - bottom
    fast = np.where(span > 0, 100.0 * (x["close"] - bottom) / span, 50.0 + 0 * (span + x["close"]))
    k = _roll(fast, k_slow_period, np.mean)
    d = _roll(k, d_period, np.mean)
    return {"fast_k": np.where(np.isnan(d), np.nan, fast), "k": np.where(np.isnan(d), np.nan, k), "d": d}


def _willr(x: Arrays, period: int) -> Arrays:
    top, bottom = _roll(x["high"], period, np.max), _roll(x["low"], period, np.min)
    span = top - bottom
    return {"willr": np.where(span == 0, 0.0, -100.0 * (top - x["close"]) / span), "highest_high": top, "lowest_low": bottom}


def _aroon(x: Arrays, period: int) -> Arrays:
    n = period + 1
    high, low = _roll(x["high"], n, np.max), _roll(x["low"], n, np.min)
    ages = [_roll(x[r], n, lambda w, axis, f=f: f(w[:, ::-1], axis=axis).astype(float)) for r, f in (("high", np.argmax), ("low", np.argmin))]
    gone = np.isnan(high) | np.isnan(low)
    up, down = (np.where(gone, np.nan, 100.0 - 100.0 * a / period) for a in ages)
    high, low = np.where(gone, np.nan, high), np.where(gone, np.nan, low)
    days = [np.where(gone, 0, a).astype(np.int64) for a in ages]
    return {"aroon_up": up, "aroon_down": down, "prev_high": high, "prev_low": low, "days_since_high": days[0], "days_since_low": days[1]}


def _aroonosc(x: Arrays, period: int) -> Arrays:
    out = _aroon(x, period)
    return {"aroonosc": out.pop("aroon_up") - out.pop("aroon_down")} | out


def _trange(x: Arrays) -> Arrays:
    c = _lag(x["close"])
    return {"trange": np.stack([x["high"] - x["low"], np.abs(x["high"] - c), np.abs(x["low"] - c)]).max(axis=0) if len(c) else c}


def _moments(x: np.ndarray, period: int) -> Arrays:
    return {"var": _roll(x, period, np.var), "sum": _roll(x, period, np.sum), "sum_sq": _roll(x * x, period, np.sum)}


def _bbands(x: Arrays, period: int, dev_up: float, dev_down: float) -> Arrays:
    m, mid = _moments(x["price"], period), _roll(x["price"], period, np.mean)
    dev = np.sqrt(m["var"])
    return {"upper": mid + dev_up * dev, "middle": mid, "lower": mid - dev_down * dev} | m


def _stddev(x: Arrays, period: int) -> Arrays:
    m = _moments(x["price"], period)
    return {"stddev": np.sqrt(m["var"]), "sum": m["sum"], "sum_sq": m["sum_sq"]}


def _mid(x: Arrays, period: int, roles: tuple[str, str], names: tuple[str, str, str]) -> Arrays:
    top, bottom = _roll(x[roles[0]], period, np.max), _roll(x[roles[1]], period, np.min)
    return {names[0]: (top + bottom) / 2.0, names[1]: top, names[2]: bottom}


def _ecl(x: Arrays) -> Arrays:
    h, low, c = (_lag(x[r]) for r in ("high", "low", "close"))
    span, h5 = h - low, h / np.where(low == 0, np.nan, low) * c
    out = {"h5": h5} | {f"h{n}": c + span * 1.1 / d for n, d in ((4, 2.0), (3, 4.0), (2, 6.0), (1, 12.0))}
    return out | {f"l{n}": c - span * 1.1 / d for n, d in ((1, 12.0), (2, 6.0), (3, 4.0), (4, 2.0))} | {"l5": c - (h5 - c)}


def _correl(x: Arrays, period: int) -> Arrays:
    gone = np.isnan(x["price"]) | np.isnan(x["price2"])
    a, b = np.where(gone, np.nan, x["price"]), np.where(gone, np.nan, x["price2"])
    ma, mb = _roll(a, period, np.mean), _roll(b, period, np.mean)
    cov = np.full(len(a), np.nan)
    if len(a) >= period:
        wa, wb = sliding_window_view(a, period), sliding_window_view(b, period)
        cov[period - 1 :] = ((wa - ma[period - 1 :, None]) * (wb - mb[period - 1 :, None])).mean(axis=1)
    s = _roll(a, period, np.std) * _roll(b, period, np.std)
    sums = {"sum_0": a, "sum_1": b, "sum_0_sq": a * a, "sum_1_sq": b * b, "sum_01": a * b}
    return {"correl": cov / np.where(s == 0, np.nan, s)} | {n: _roll(v, period, np.sum) for n, v in sums.items()}


def _candle(x: Arrays, body_percent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    o, h, low, c = (x[r] for r in ("open", "high", "low", "close"))
    body, span = np.abs(c - o), h - low
    return body, (span > 0) & (body <= span * body_percent / 100.0), h - np.maximum(o, c), np.minimum(o, c) - low


def _doji(x: Arrays, body_percent: float, shadow_equal_percent: float) -> Arrays:
    _, small, up, down = _candle(x, body_percent)
    differ = np.where((down > 0) & (up > 0), np.minimum(np.abs(up - down) / down * 100.0, np.abs(down - up) / up * 100.0), 100.0)
    return {"signal": np.where(small & (differ < shadow_equal_percent), PATTERN, NEUTRAL)}


def _dragonfly(x: Arrays, body_percent: float) -> Arrays:
    body, small, up, _ = _candle(x, body_percent)
    return {"signal": np.where(small & (up <= body), BULLISH, NEUTRAL)}


def _gravestone(x: Arrays, body_percent: float) -> Arrays:
    body, small, _, down = _candle(x, body_percent)
    return {"signal": np.where(small & (down <= body), BEARISH, NEUTRAL)}


def _bop(x: Arrays) -> Arrays:
    span = x["high"] - x["low"]
    return {"bop": np.where(span == 0, 0.0, (x["close"] - x["open"]) / span)}


def _wma(x: Arrays, period: int) -> Arrays:
    weights = np.arange(1, period + 1, dtype=float)
    return {"wma": _roll(x["price"], period, lambda w, axis: w @ weights / weights.sum())}


def _one(name: str, how: Callable[..., np.ndarray]) -> Callable[..., Arrays]:
    return lambda x, period: {name: _roll(x["price"], period, how)}


def _rates(name: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., Arrays]:
    return lambda x, period: {name: f(*_change(x, period))}


WHOLE: dict[str, Callable[..., Arrays]] = {
    "sma": _one("sma", np.mean), "max": _one("max", np.max), "min": _one("min", np.min), "sum": _one("sum", np.sum),
    "wma": _wma, "trima": _trima, "mom": lambda x, period: {"mom": x["price"] - _lag(x["price"], period)},
    "roc": _rates("roc", lambda v, p: (v - p) / p * 100.0), "rocp": _rates("rocp", lambda v, p: (v - p) / p),
    "rocr": _rates("rocr", lambda v, p: v / p), "rocr100": _rates("rocr100", lambda v, p: v / p * 100.0),
    "cci": _cci, "mfi": _mfi, "stoch": _stoch, "willr": _willr, "bop": _bop, "aroon": _aroon, "aroonosc": _aroonosc,
    "trange": _trange, "bbands": _bbands, "adr": lambda x, period: {"adr": _roll(x["high"] - x["low"], period, np.mean)},
    "medprice": lambda x: {"medprice": (x["high"] + x["low"]) / 2.0}, "typprice": lambda x: {"typprice": _typical(x)},
    "wclprice": lambda x: {"wclprice": (x["high"] + x["low"] + 2.0 * x["close"]) / 4.0},
    "midpoint": lambda x, period: _mid(x, period, ("price", "price"), ("midpoint", "highest", "lowest")),
    "midprice": lambda x, period: _mid(x, period, ("high", "low"), ("midprice", "highest_high", "lowest_low")),
    "ecl": _ecl, "cdl_doji": _doji, "cdl_dragonfly_doji": _dragonfly, "cdl_gravestone_doji": _gravestone,
    "var": lambda x, period: _moments(x["price"], period), "stddev": _stddev, "correl": _correl,
}


class Windowed(K.Kernel):
    def __init__(self, name: str, params: dict[str, Any]):
        super().__init__()
        self.name, self.params = name, params
        self.keep = CATALOG[name].lookback(**params)
        self.tail: Arrays = {}

    def run(self, x: Arrays) -> Arrays:
        whole = {r: np.concatenate([self.tail[r], v]) if self.tail else v for r, v in x.items()}
        n = len(next(iter(x.values())))
        out = {k: v[len(v) - n :] for k, v in WHOLE[self.name](whole, **self.params).items()}
        self.tail = {r: v[max(0, len(v) - self.keep) :].copy() if self.keep else v[:0] for r, v in whole.items()}
        return out


class Ad(K.Kernel):
    def __init__(self) -> None:
        super().__init__()
        self.sum = K.Running()

    def run(self, x: Arrays) -> Arrays:
        return {"ad": self.sum(K.money_flow_volume(x))}


class Obv(K.Kernel):
    def __init__(self) -> None:
        super().__init__()
        self.sum, self.before = K.Running(), K.Before()

    def run(self, x: Arrays) -> Arrays:
        d = x["close"] - self.before(x["close"])
        step = np.where(d > 0, x["volume"], np.where(d < 0, -x["volume"], 0.0))
        if not self.done and len(step):
            step[0] = x["volume"][0]
        step[np.isnan(x["close"]) | np.isnan(x["volume"])] = np.nan
        return {"obv": self.sum(step)}


class Vwap(K.Kernel):
    def __init__(self) -> None:
        super().__init__()
        self.pv, self.volume = K.Running(), K.Running()

    def run(self, x: Arrays) -> Arrays:
        pv, volume = self.pv(_typical(x) * x["volume"]), self.volume(x["volume"])
        return {"vwap": np.where(volume == 0, 0.0, pv / volume), "cum_pv": pv, "cum_vol": volume}


RUNNING = {"ad": Ad, "obv": Obv, "vwap": Vwap}


def stepper(name: str, params: dict[str, Any]) -> K.Kernel:
    """Any operator as a kernel."""
    if name in K.MAKERS:
        return K.kernel(name, params)
    return RUNNING[name]() if name in RUNNING else Windowed(name, params)

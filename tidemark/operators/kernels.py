"""Recursive operators over one series in order, a chunk at a time.

A kernel holds what its next value needs and no more, so a series of any length passes through in
chunks, and the same kernel serves batches and streams. Linear recurrences y = a*y + b*x run in compiled
code (an exponentially weighted mean is that recurrence); only the two state machines loop.
NaN stands for "no value"; an input without a value makes all later values of a recurrence NaN, those of the
two state machines and of sums from the start too. (Chunks of fewer than 16 bars are stepped one by one, longer
ones in compiled code; the two differ by rounding.)
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd

from tidemark.options import BEARISH, BULLISH, INVALID, NEUTRAL

Arrays = dict[str, np.ndarray]


class Recurrence:
    """y = a*y + b*x after a seed: the mean or sum of ``n`` inputs that follow ``skip`` others. ``twice``:
    the last input of the seed is stepped once more."""

    def __init__(self, n: int, a: float, b: float, skip: int = 0, total: bool = False, twice: bool = False):
        self.n, self.a, self.b, self.skip, self.total, self.twice = n, a, b, skip, total, twice
        self.seed: list[float] = []
        self.y: float | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = min(self.skip, len(x))
        self.skip -= at
        if self.y is None:
            take = x[at : at + self.n - len(self.seed)]
            self.seed += take.tolist()
            at += len(take)
            if len(self.seed) < self.n:
                return out
            self.y = float(sum(self.seed)) / (1 if self.total else self.n)
            if self.twice:
                self.y = self.a * self.y + self.b * self.seed[-1]
            out[at - 1] = self.y
            self.seed = []
        rest = x[at:]
        if len(rest):
            out[at:] = self._steps(rest)
            self.y = float(out[-1])
        return out

    def _steps(self, x: np.ndarray) -> np.ndarray:
        bad = np.flatnonzero(np.isnan(x))
        good = len(x) if not len(bad) else int(bad[0])
        out = np.full(len(x), np.nan)
        if good and not np.isnan(self.y):
            if len(x) < 16:
                y = self.y
                for k in range(good):
                    y = self.a * y + self.b * x[k]
                    out[k] = y
            else:
                alpha = 1 - self.a
                scale = self.b / alpha
                z = np.empty(good + 1)
                z[0] = self.y / scale
                z[1:] = x[:good]
                out[:good] = pd.Series(z).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:] * scale
        return out


def _ema(period: int, skip: int = 0, k: float | None = None, **more: Any) -> Recurrence:
    k = 2.0 / (period + 1) if k is None else k
    return Recurrence(period, 1 - k, k, skip, **more)


def _wilder_mean(period: int, skip: int = 0) -> Recurrence:
    return Recurrence(period, (period - 1) / period, 1 / period, skip)


def _wilder_sum(period: int) -> Recurrence:
    """Of bars 1 to period - 1, then stepped."""
    return Recurrence(period - 1, 1 - 1 / period, 1.0, 1, total=True)


class Before:
    """The values one bar earlier."""

    def __init__(self) -> None:
        self.last = np.nan

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        if len(x):
            out[0], out[1:] = self.last, x[:-1]
            self.last = float(x[-1])
        return out


class Kernel:
    """``done``: bars seen before this chunk."""

    def __init__(self) -> None:
        self.done = 0

    def __call__(self, x: Arrays) -> Arrays:
        n = len(next(iter(x.values())))
        with np.errstate(all="ignore"):
            out = self.run(x)
        self.done += n
        return out

    def run(self, x: Arrays) -> Arrays:
        raise NotImplementedError

    def mask(self, out: Arrays, lookback: int) -> Arrays:
        left = lookback - self.done
        if left > 0:
            for v in out.values():
                v[:left] = np.nan
        return out


class Ema(Kernel):
    def __init__(self, period: int, k: float | None = None):
        super().__init__()
        self.ema = _ema(period, k=k)

    def run(self, x: Arrays) -> Arrays:
        return {"ema": self.ema(x["price"])}


class Rma(Kernel):
    def __init__(self, period: int):
        super().__init__()
        self.rma = _wilder_mean(period)

    def run(self, x: Arrays) -> Arrays:
        return {"rma": self.rma(x["price"])}


class Chain(Kernel):
    """Averages of averages; ``weights`` make the main output."""

    def __init__(self, name: str, period: int, weights: dict[int, float], depth: int):
        super().__init__()
        self.name, self.weights = name, weights
        self.steps = [_ema(period, j * (period - 1)) for j in range(depth)]
        self.lookback = depth * (period - 1)

    def run(self, x: Arrays) -> Arrays:
        e, v = [], x["price"]
        for step in self.steps:
            v = step(v)
            e.append(v)
        main = sum(w * e[j - 1] for j, w in self.weights.items())
        return self.mask({self.name: main} | {f"ema{j + 1}": v for j, v in enumerate(e)}, self.lookback)


def _dema(period: int) -> Chain:
    return Chain("dema", period, {1: 2.0, 2: -1.0}, 2)


def _tema(period: int) -> Chain:
    return Chain("tema", period, {1: 3.0, 2: -3.0, 3: 1.0}, 3)


def _t3(period: int, vfactor: float) -> Chain:
    v, v2, v3 = vfactor, vfactor**2, vfactor**3
    return Chain("t3", period, {6: -v3, 5: 3 * v2 + 3 * v3, 4: -6 * v2 - 3 * v - 3 * v3, 3: 1 + 3 * v + v3 + 3 * v2}, 6)


class Trix(Chain):
    def __init__(self, period: int):
        super().__init__("trix", period, {3: 1.0}, 3)
        self.lookback += 1
        self.before = Before()

    def run(self, x: Arrays) -> Arrays:
        v = x["price"]
        e = []
        for step in self.steps:
            v = step(v)
            e.append(v)
        p = self.before(v)
        return self.mask({"trix": (v - p) / p * 100.0} | {f"ema{j + 1}": v for j, v in enumerate(e)}, self.lookback)


class Macd(Kernel):
    def __init__(self, fast_period: int, slow_period: int, signal_period: int):
        super().__init__()
        self.fast, self.slow = _ema(fast_period), _ema(slow_period)
        self.signal = _ema(signal_period, slow_period - 1)
        self.lookback = slow_period + signal_period - 2

    def run(self, x: Arrays) -> Arrays:
        fast, slow = self.fast(x["price"]), self.slow(x["price"])
        line = fast - slow
        signal = self.signal(line)
        return self.mask({"macd_line": line, "signal": signal, "histogram": line - signal, "fast_ema": fast, "slow_ema": slow}, self.lookback)


class Rsi(Kernel):
    def __init__(self, period: int):
        super().__init__()
        self.before, self.gain, self.loss = Before(), _wilder_mean(period, 1), _wilder_mean(period, 1)

    def run(self, x: Arrays) -> Arrays:
        d = x["price"] - self.before(x["price"])
        gain, loss = self.gain(np.where(d > 0, d, d * 0)), self.loss(np.where(d < 0, -d, d * 0))
        rsi = np.where(loss == 0, 100.0 + 0 * gain, 100.0 - 100.0 / (1.0 + gain / loss))
        return {"rsi": rsi, "avg_gain": gain, "avg_loss": loss}


class Moves:
    """Directional movements and true range against the bar before."""

    def __init__(self) -> None:
        self.high, self.low, self.close = Before(), Before(), Before()

    def __call__(self, x: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down = x["high"] - self.high(x["high"]), self.low(x["low"]) - x["low"]
        none = (up + down) * 0
        plus = np.where((up > down) & (up > 0), up, none)
        minus = np.where((down > up) & (down > 0), down, none)
        if "close" not in x:
            return plus, minus, none
        c = self.close(x["close"])
        spans = np.stack([x["high"] - x["low"], np.abs(x["high"] - c), np.abs(x["low"] - c)])
        return plus, minus, spans.max(axis=0) if len(c) else none


class Dm(Kernel):
    def __init__(self, period: int, name: str):
        super().__init__()
        self.name, self.moves, self.sum = name, Moves(), _wilder_sum(period)

    def run(self, x: Arrays) -> Arrays:
        plus, minus, _ = self.moves(x)
        return {self.name: self.sum(plus if self.name == "plus_dm" else minus)}


class Direction:
    """Smoothed movements and range, from bar ``period`` on."""

    def __init__(self, period: int):
        self.moves = Moves()
        self.plus, self.minus, self.range = (_wilder_sum(period) for _ in range(3))

    def __call__(self, x: Arrays) -> Arrays:
        plus, minus, tr = self.moves(x)
        p, m, r = self.plus(plus), self.minus(minus), self.range(tr)
        plus_di, minus_di = (np.where(r == 0, 0.0 * v, 100.0 * v / r) for v in (p, m))
        dx = 100.0 * np.abs(plus_di - minus_di) / (plus_di + minus_di)
        return {"plus_di": plus_di, "minus_di": minus_di, "dx": dx, "smoothed_plus_dm": p, "smoothed_minus_dm": m, "smoothed_tr": r}


class Di(Kernel):
    def __init__(self, period: int, outputs: tuple[str, ...]):
        super().__init__()
        self.period, self.outputs, self.direction = period, outputs, Direction(period)

    def run(self, x: Arrays) -> Arrays:
        got = self.direction(x)
        return self.mask({n: got[n] for n in self.outputs}, self.period)


class Adx(Kernel):
    """And, with ``rating``, the mean of it and its value period - 1 bars earlier."""

    def __init__(self, period: int, rating: bool = False):
        super().__init__()
        self.direction, self.mean = Direction(period), _wilder_mean(period, period)
        self.back = np.full(period - 1, np.nan) if rating else None
        self.lookback = 3 * period - 2 if rating else 2 * period - 1

    def run(self, x: Arrays) -> Arrays:
        got = self.direction(x)
        adx = self.mean(got["dx"])
        out = {"adx": adx} | {n: got[n] for n in ("smoothed_plus_dm", "smoothed_minus_dm", "smoothed_tr")}
        if self.back is not None:
            both = np.concatenate([self.back, adx])
            out = {"adxr": (adx + both[: len(adx)]) / 2.0} | out
            self.back = both[len(adx) :]
        return self.mask(out, self.lookback)


class Atr(Kernel):
    def __init__(self, period: int, relative: bool = False):
        super().__init__()
        self.moves, self.mean, self.relative = Moves(), _wilder_mean(period, 1), relative

    def run(self, x: Arrays) -> Arrays:
        atr = self.mean(self.moves(x)[2])
        return {"natr": atr / x["close"] * 100.0} if self.relative else {"atr": atr}


class Sar(Kernel):
    """Parabolic stop and reverse."""

    def __init__(self, acceleration: float, maximum: float):
        super().__init__()
        self.start, self.most = acceleration, maximum
        self.highs: list[float] = []  # of the last two bars
        self.lows: list[float] = []
        self.long, self.sar, self.af, self.ep, self.since = True, np.nan, 0.0, np.nan, 1
        self.lost = False

    def run(self, x: Arrays) -> Arrays:
        highs, lows = x["high"].tolist(), x["low"].tolist()
        sar, long, af, ep = [], [], [], []
        for k, (high, low) in enumerate(zip(highs, lows, strict=True)):
            i = self.done + k
            self.lost |= math.isnan(high) or math.isnan(low)
            if self.lost:
                for out, nothing in ((sar, np.nan), (long, None), (af, np.nan), (ep, np.nan)):
                    out.append(nothing)
                continue
            if i == 1:
                self.long = high - self.highs[-1] >= self.lows[-1] - low
                self.sar = self.lows[-1] if self.long else self.highs[-1]
                self.ep = high if self.long else low
                self.af = self.start
            elif i > 1:
                self._step(i, high, low)
            sar.append(self.sar)
            long.append(None if i == 0 else self.long)
            af.append(self.af)
            ep.append(self.ep)
            self.highs, self.lows = [*self.highs[-1:], high], [*self.lows[-1:], low]
        return {"sar": np.array(sar), "is_long": np.array(long, object), "af": np.array(af), "ep": np.array(ep)}

    def _step(self, i: int, high: float, low: float) -> None:
        near = 1 if i - self.since < 2 else 2
        sar = self.sar + self.af * (self.ep - self.sar)
        if self.long:
            sar = min([sar, *self.lows[-near:]])
            grown, crossed = high > self.ep, low < sar
            extreme, other = high, low
        else:
            sar = max([sar, *self.highs[-near:]])
            grown, crossed = low < self.ep, high > sar
            extreme, other = low, high
        if grown:
            self.ep = extreme
            self.af = min(self.af + self.start, self.most)
        if crossed:
            self.long = not self.long
            sar, self.ep, self.af, self.since = self.ep, other, self.start, i - 1
        self.sar = sar


class Supertrend(Kernel):
    def __init__(self, period: int, multiplier: float):
        super().__init__()
        self.atr, self.by, self.period = Atr(period), multiplier, period
        self.last: tuple[int, float, float, float] | None = None  # trend, upper, lower, close
        self.lost = False

    def run(self, x: Arrays) -> Arrays:
        atr = self.atr(x)["atr"]
        mid = (x["high"] + x["low"]) / 2.0
        uppers, lowers = (mid + self.by * atr).tolist(), (mid - self.by * atr).tolist()
        n = len(atr)
        trend, stop, up, low = np.zeros(n, np.int64), np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
        last = self.last
        gone = np.logical_or.accumulate(np.append(self.lost, np.isnan(x["high"]) | np.isnan(x["low"]) | np.isnan(x["close"])))[1:]
        for k, c in enumerate(x["close"].tolist()):
            if gone[k] or self.done + k < self.period:
                continue
            u, d = uppers[k], lowers[k]
            if last is None:
                t = BULLISH
            else:
                was, pu, pl, pc = last
                if pc <= pu:
                    u = min(u, pu)
                if pc >= pl:
                    d = max(d, pl)
                if was == BULLISH:
                    t = BEARISH if c < d else BULLISH
                else:
                    t = BULLISH if c > u else BEARISH
            last = (t, u, d, c)
            trend[k], stop[k], up[k], low[k] = t, d if t == BULLISH else u, u, d
        self.last, self.lost = last, bool(gone[-1]) if n else self.lost
        atr = np.where(gone, np.nan, atr)
        return {"supertrend": stop, "trend": trend, "atr": atr, "upper": up, "lower": low}


class Running:
    """A sum from the start."""

    def __init__(self) -> None:
        self.sum = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.sum + np.cumsum(x)
        if len(out):
            self.sum = float(out[-1])
        return out


def money_flow_volume(x: Arrays) -> np.ndarray:
    span = x["high"] - x["low"]
    return np.where(span == 0, 0.0 * span, ((x["close"] - x["low"]) - (x["high"] - x["close"])) / span) * x["volume"]


class Adosc(Kernel):
    def __init__(self, fast_period: int, slow_period: int):
        super().__init__()
        self.ad, self.fast, self.slow = Running(), _ema(fast_period), _ema(slow_period)

    def run(self, x: Arrays) -> Arrays:
        ad = self.ad(money_flow_volume(x))
        fast, slow = self.fast(ad), self.slow(ad)
        return {"adosc": fast - slow, "ad": ad, "fast_ema": fast, "slow_ema": slow}


class Ha(Kernel):
    def __init__(self) -> None:
        super().__init__()
        self.before, self.open = Before(), Recurrence(1, 0.5, 0.5)

    def run(self, x: Arrays) -> Arrays:
        close = (x["open"] + x["high"] + x["low"] + x["close"]) / 4.0
        source = self.before(close)
        first = self.done == 0 and len(close) > 0
        if first:
            source[0] = (x["open"][0] + x["close"][0]) / 2.0
        open_ = self.open(source)
        high, low = np.maximum(np.maximum(x["high"], open_), close), np.minimum(np.minimum(x["low"], open_), close)
        if first:
            high[0], low[0] = x["high"][0], x["low"][0]
        return {"ha_open": open_, "ha_high": high, "ha_low": low, "ha_close": close}


class Vegas(Kernel):
    #: The periods of the four averages.
    PERIODS = {"channel_upper": 144, "channel_lower": 169, "boundary_upper": 576, "boundary_lower": 676}

    def __init__(self) -> None:
        super().__init__()
        self.emas = {n: _ema(p) for n, p in self.PERIODS.items()}

    def run(self, x: Arrays) -> Arrays:
        out = {n: e(x["price"]) for n, e in self.emas.items()}
        self.mask({"channel_upper": out["channel_upper"]}, 675)
        return out


class Candle(Kernel):
    """Patterns that compare a body with the average body."""

    def __init__(self, name: str, period: int, limit: float):
        super().__init__()
        self.name, self.period, self.limit = name, period, limit
        self.average = _ema(period, twice=name != "cdl_marubozu")
        self.before = Before()

    def run(self, x: Arrays) -> Arrays:
        o, h, low, c = (x[r] for r in ("open", "high", "low", "close"))
        body = np.abs(c - o)
        up, down, mid = h - np.maximum(o, c), np.minimum(o, c) - low, (h + low) / 2.0
        average = self.average(body)
        before = self.before(average)
        small = (body <= average) & (body > 0)
        signal = np.full(len(o), NEUTRAL, np.int64)
        if self.name == "cdl_hammer":
            signal[small & (down >= self.limit * body) & (up <= body) & (np.minimum(o, c) > mid)] = BULLISH
        elif self.name == "cdl_inverted_hammer":
            signal[small & (up >= self.limit * body) & (down <= body) & (np.maximum(o, c) < mid)] = BULLISH
        elif self.name == "cdl_long_shadow":
            least = (self.limit / 100.0) * (h - low)
            long_up, long_down = up >= least, down >= least
            signal[(body <= average) & long_up & ~long_down] = BEARISH
            signal[(body <= average) & long_down & ~long_up] = BULLISH
        else:
            most = body * self.limit / 100.0
            bare = (body > before) & (up <= most) & (down <= most)
            signal[bare] = np.where(c > o, BULLISH, BEARISH)[bare]
        left = self.period - 1 - self.done
        if left > 0:
            signal[:left] = NEUTRAL if self.name == "cdl_marubozu" else INVALID
        return {"signal": signal, "body_avg": average}


MAKERS = {
    "ema": Ema, "rma": Rma, "dema": _dema, "tema": _tema, "t3": _t3, "trix": Trix, "macd": Macd, "rsi": Rsi,
    "plus_dm": lambda period: Dm(period, "plus_dm"), "minus_dm": lambda period: Dm(period, "minus_dm"),
    "plus_di": lambda period: Di(period, ("plus_di", "smoothed_plus_dm", "smoothed_tr")),
    "minus_di": lambda period: Di(period, ("minus_di", "smoothed_minus_dm", "smoothed_tr")),
    "dx": lambda period: Di(period, ("dx", "smoothed_plus_dm", "smoothed_minus_dm", "smoothed_tr")),
    "adx": Adx, "adxr": lambda period: Adx(period, True), "atr": Atr, "natr": lambda period: Atr(period, True),
    "sar": Sar, "supertrend": Supertrend, "adosc": Adosc, "ha": Ha, "vegas": Vegas,
    "cdl_hammer": lambda period, factor: Candle("cdl_hammer", period, factor),
    "cdl_inverted_hammer": lambda period, factor: Candle("cdl_inverted_hammer", period, factor),
    "cdl_long_shadow": lambda period, shadow_factor: Candle("cdl_long_shadow", period, shadow_factor),
    "cdl_marubozu": lambda period, shadow_percent: Candle("cdl_marubozu", period, shadow_percent),
}

#: These have values before their lookback, which a series too short for it must not show.
NEED_LENGTH = {"vegas", "adosc", "ha"}


def kernel(name: str, params: dict[str, Any]) -> Kernel:
    return MAKERS[name](**params)

"""A query for every operator over daily bars, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions as helpers
from tidemark import sources
from tidemark.operators.catalog import CATALOG, indicator
from tidemark.options import Series
from tidemark.plans.batch import with_indicators
from tidemark.plans.sql import register
from tidemark.streaming.incremental import Incremental

Query = Callable[[SparkSession, str], DataFrame]

#: Decimals that results are rounded to: sums and squares are large, and engines add in different orders.
DECIMALS = {"smoothed_plus_dm": 1, "smoothed_minus_dm": 1, "smoothed_tr": 1, "var": -2, "sum_sq": -3, "sum_0_sq": -3, "sum_1_sq": -1, "sum_01": -1, "cum_pv": -3, "pos_flow": 1, "neg_flow": 1, "money_flow": 1, "channel_upper": 2, "channel_lower": 2, "boundary_upper": 2, "boundary_lower": 2, "plus_dm": 1, "minus_dm": 1}
#: Decimals of the inputs show through here, so that a coarser rounding would meet exact halves.
DECIMALS |= dict.fromkeys(("trima", "sma1", "medprice", "typprice", "wclprice", *(f"{s}{k}" for s in "hl" for k in range(1, 6))), 6)


#: And here, as means of inputs with two decimals meet them too.
DECIMALS |= dict.fromkeys(("upper", "middle", "lower", "ha_open", "ha_high", "ha_low", "ha_close", "pos_flow", "neg_flow", "money_flow"), 5)


def decimals(output: str) -> int:
    return DECIMALS.get(output, 3)


def _plain(column: str, kind: str) -> Column:
    return F.coalesce(column, F.lit(False)).alias(column) if kind == "boolean" else F.col(column)


def operator_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(with_indicators(sources.daily(spark, sf_dir), [indicator(name)]), name)

    return run


BARS = """b AS (
  SELECT l_returnflag || l_linestatus AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS ts,
    arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL
), s AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n, (high + low + close) / 3 AS tp,
    lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(high, 2) OVER w AS ph2, lag(low, 2) OVER w AS pl2, abs(close - open) AS body
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)
)"""


def frame(length: int) -> str:
    return f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"


def full(value: str, length: int, start: int = 1) -> str:
    """The value once a frame of this length that starts at bar ``start`` or later is full."""
    return f"CASE WHEN rn >= {length + start - 1} THEN {value} END"


def recurrence(name: str, source: str, x: str, start: int, n: int, a: str, b: str, total: bool = False, twice: bool = False) -> str:
    """Tables name_s (seeds) and name (symbol, rn, y)."""
    seed = f"SELECT symbol, {'sum' if total else 'avg'}({x}) AS y FROM {source} WHERE rn BETWEEN {start} AND {start + n - 1} GROUP BY symbol HAVING count({x}) = {n}"
    if twice:
        seed = f"SELECT q.symbol, ({a}) * q.y + ({b}) * z.{x} AS y FROM ({seed}) q JOIN {source} z ON z.symbol = q.symbol AND z.rn = {start + n - 1}"
    return f"""{name}_s AS ({seed}), {name} AS (
  SELECT symbol, {start + n - 1}::BIGINT AS rn, y FROM {name}_s
  UNION ALL SELECT r.symbol, r.rn + 1, ({a}) * r.y + ({b}) * z.{x} FROM {name} r JOIN {source} z ON z.symbol = r.symbol AND z.rn = r.rn + 1
)"""


def ema(name: str, source: str, x: str, start: int, period: int) -> str:
    k = f"2.0::DOUBLE / {period + 1}"
    return recurrence(name, source, x, start, period, f"1 - {k}", k)


def wilder(name: str, source: str, x: str, start: int, period: int) -> str:
    return recurrence(name, source, x, start, period, f"{period - 1}::DOUBLE / {period}", f"1::DOUBLE / {period}")


def summed(name: str, source: str, x: str, period: int) -> str:
    return recurrence(name, source, x, 2, period - 1, f"1 - 1::DOUBLE / {period}", "1::DOUBLE", total=True)


def _sql(tables: list[str], source: str, outputs: dict[str, str], name: str) -> str:
    kinds = dict(CATALOG[name].outputs)
    columns = [f"round(({e})::DOUBLE, {decimals(o)}) + 0.0::DOUBLE AS {name}_{o}" if kinds[o] == "double" else f"({e})::{kinds[o].upper()} AS {name}_{o}" for o, e in outputs.items()]
    return f"WITH RECURSIVE {', '.join([BARS, *tables])} SELECT symbol, ts, {', '.join(columns)} FROM {source}"


def _joined(*names: str) -> str:
    return "(SELECT s.*, " + ", ".join(f"{n}.y AS {n}" for n in names) + " FROM s" + "".join(f" LEFT JOIN {n} USING (symbol, rn)" for n in names) + ") t"


def _from(lookback: int, outputs: dict[str, str]) -> dict[str, str]:
    return {k: f"CASE WHEN rn > {lookback} THEN {v} END" for k, v in outputs.items()}


MOVES = """m AS MATERIALIZED (
  SELECT *, CASE WHEN rn > 1 THEN CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END END AS plus,
    CASE WHEN rn > 1 THEN CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END END AS minus,
    CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
  FROM s
)"""


def _direction(period: int) -> list[str]:
    return [MOVES, summed("dp", "m", "plus", period), summed("dm", "m", "minus", period), summed("dr", "m", "tr", period), f"""d AS MATERIALIZED (
  SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM (
    SELECT s.*, dp.y AS p, dm.y AS mi, dr.y AS r, coalesce(100 * dp.y / nullif(dr.y, 0), 0) AS pdi, coalesce(100 * dm.y / nullif(dr.y, 0), 0) AS mdi
    FROM s LEFT JOIN dp USING (symbol, rn) LEFT JOIN dm USING (symbol, rn) LEFT JOIN dr USING (symbol, rn)) WHERE rn > {period} OR true
)"""]  # fmt: skip


def _candle(name: str, conditions: str) -> str:
    k = "2.0::DOUBLE / 15"
    average = recurrence("e", "s", "body", 1, 14, f"1 - {k}", k, twice=name != "cdl_marubozu")
    source = "(SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY rn) AS pe, high - greatest(open, close) AS us, least(open, close) - low AS ls FROM " + _joined("e") + ") u"
    return _sql([average], source, {"signal": conditions, "body_avg": "e"}, name)


def _over(name: str, tables: list[str] | None = None, source: str = "s", **outputs: str) -> str:
    return _sql(tables or [], source, outputs, name)


def _change(name: str, period: int, formula: str) -> str:
    return _over(name, source=f"(SELECT *, lag(close, {period}) OVER (PARTITION BY symbol ORDER BY rn) AS p FROM s) t", **{name: formula})


def _simple_sql() -> dict[str, str]:
    w14, w3, w20, w30 = frame(14), frame(3), frame(20), frame(30)
    span = "nullif(high - low, 0)"
    top, bottom = f"max(high) OVER {w14}", f"min(low) OVER {w14}"
    extremes = f"(SELECT *, {full(top, 14)} AS hh, {full(bottom, 14)} AS ll FROM s) t"
    small = "high - low > 0 AND abs(close - open) <= (high - low) * 5.0::DOUBLE / 100"
    us, ls = "(high - greatest(open, close))", "(least(open, close) - low)"
    ages = f"""(SELECT *, CASE WHEN rn > 14 THEN rn - th.n END AS dh, CASE WHEN rn > 14 THEN rn + tl.n END AS dl FROM (
      SELECT *, max({{'v': high, 'n': rn}}) OVER {frame(15)} AS th, min({{'v': low, 'n': -rn}}) OVER {frame(15)} AS tl FROM s)) t"""
    aged = {"prev_high": "CASE WHEN rn > 14 THEN th.v END", "prev_low": "CASE WHEN rn > 14 THEN tl.v END", "days_since_high": "coalesce(dh, 0)", "days_since_low": "coalesce(dl, 0)"}
    fast = f"(SELECT *, CASE WHEN rn >= 14 THEN coalesce(100 * (close - ll) / nullif(hh - ll, 0), 50) END AS f FROM {extremes}) q"
    flows = "(SELECT *, tp * volume AS mf, CASE WHEN ptp IS NULL THEN NULL WHEN tp > ptp THEN tp * volume ELSE 0 END AS pos, CASE WHEN ptp IS NULL THEN NULL WHEN tp < ptp THEN tp * volume ELSE 0 END AS neg FROM (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY rn) AS ptp FROM s)) q"
    summed_flows = f"(SELECT *, CASE WHEN rn > 14 THEN sum(pos) OVER {w14} END AS p, CASE WHEN rn > 14 THEN sum(neg) OVER {w14} END AS ng FROM {flows}) t"
    run = "(PARTITION BY symbol ORDER BY rn)"
    mfv = f"coalesce(((close - low) - (high - close)) / {span}, 0) * volume"
    moments = {"var": full(f"var_pop(close) OVER {w14}", 14), "sum": full(f"sum(close) OVER {w14}", 14), "sum_sq": full(f"sum(close * close) OVER {w14}", 14)}
    ecl = {"h5": "ph / nullif(pl, 0) * pc"} | {f"h{k}": f"pc + (ph - pl) * 1.1::DOUBLE / {d}" for k, d in ((4, 2), (3, 4), (2, 6), (1, 12))}
    ecl |= {f"l{k}": f"pc - (ph - pl) * 1.1::DOUBLE / {d}" for k, d in ((1, 12), (2, 6), (3, 4), (4, 2))} | {"l5": "pc - (ph / nullif(pl, 0) * pc - pc)"}
    cci = f"""(SELECT *, list_sum(list_transform(l, lambda v: abs(v - mean))) / 14 AS dev FROM (
      SELECT *, {full(f'avg(tp) OVER {w14}', 14)} AS mean, list(tp) OVER {w14} AS l FROM s)) t"""
    return {
        "sma": _over("sma", sma=full(f"avg(close) OVER {w14}", 14)),
        "wma": _over("wma", source=f"(SELECT *, list(close) OVER {w30} AS l FROM s) t", wma=full("list_sum(list_transform(l, lambda v, i: v * i)) / 465", 30)),
        "trima": _over("trima", source=f"(SELECT *, CASE WHEN rn >= 30 THEN avg(f) OVER {frame(15)} END AS g FROM (SELECT *, {full(f'avg(close) OVER {frame(16)}', 16)} AS f FROM s)) t", trima="g", sma1="CASE WHEN rn >= 30 THEN f END"),
        "mom": _change("mom", 14, "close - p"),
        "roc": _change("roc", 14, "(close - p) / nullif(p, 0) * 100"),
        "rocp": _change("rocp", 10, "(close - p) / nullif(p, 0)"),
        "rocr": _change("rocr", 10, "close / nullif(p, 0)"),
        "rocr100": _change("rocr100", 10, "close / nullif(p, 0) * 100"),
        "cci": _over("cci", source=cci, cci="CASE WHEN mean IS NOT NULL THEN coalesce((tp - mean) / (nullif(dev, 0) * 0.015::DOUBLE), 0) END", tp="CASE WHEN mean IS NOT NULL THEN tp END", tp_sma="mean", mean_dev="CASE WHEN mean IS NOT NULL THEN dev END"),
        "mfi": _over("mfi", source=summed_flows, mfi="CASE WHEN p + ng < 1 THEN 0 ELSE 100 * (p / nullif(p + ng, 0)) END", typ_price="CASE WHEN rn > 14 THEN tp END", money_flow="CASE WHEN rn > 14 THEN mf END", pos_flow="p", neg_flow="ng"),
        "stoch": _over("stoch", source=f"(SELECT *, CASE WHEN rn >= 18 THEN avg(k0) OVER {w3} END AS d0 FROM (SELECT *, CASE WHEN rn >= 16 THEN avg(f) OVER {w3} END AS k0 FROM {fast})) t", fast_k="CASE WHEN rn >= 18 THEN f END", k="CASE WHEN rn >= 18 THEN k0 END", d="d0"),
        "willr": _over("willr", source=extremes, willr="CASE WHEN rn >= 14 THEN coalesce(-100 * (hh - close) / nullif(hh - ll, 0), 0) END", highest_high="hh", lowest_low="ll"),
        "bop": _over("bop", bop=f"coalesce((close - open) / {span}, 0)"),
        "aroon": _over("aroon", source=ages, aroon_up="100 - 100 * dh / 14::DOUBLE", aroon_down="100 - 100 * dl / 14::DOUBLE", **aged),
        "aroonosc": _over("aroonosc", source=ages, aroonosc="(100 - 100 * dh / 14::DOUBLE) - (100 - 100 * dl / 14::DOUBLE)", **aged),
        "trange": _over("trange", trange="CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"),
        "bbands": _over("bbands", source=f"(SELECT *, {full(f'avg(close) OVER {w20}', 20)} AS m, {full(f'stddev_pop(close) OVER {w20}', 20)} AS sd, {full(f'var_pop(close) OVER {w20}', 20)} AS va, {full(f'sum(close) OVER {w20}', 20)} AS su, {full(f'sum(close * close) OVER {w20}', 20)} AS sq FROM s) t", upper="m + 2 * sd", middle="m", lower="m - 2 * sd", var="va", sum="su", sum_sq="sq"),
        "adr": _over("adr", adr=full(f"avg(high - low) OVER {w3}", 3)),
        "ad": _over("ad", ad=f"sum({mfv}) OVER {run}"),
        "obv": _over("obv", obv=f"sum(CASE WHEN rn = 1 THEN volume WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER {run}"),
        "vwap": _over("vwap", source=f"(SELECT *, sum(tp * volume) OVER {run} AS pv, sum(volume) OVER {run} AS v FROM s) t", vwap="coalesce(pv / nullif(v, 0), 0)", cum_pv="pv", cum_vol="v"),
        "medprice": _over("medprice", medprice="(high + low) / 2"),
        "typprice": _over("typprice", typprice="tp"),
        "wclprice": _over("wclprice", wclprice="(high + low + close * 2) / 4"),
        "midpoint": _over("midpoint", source=f"(SELECT *, {full(f'max(close) OVER {w14}', 14)} AS a, {full(f'min(close) OVER {w14}', 14)} AS z FROM s) t", midpoint="(a + z) / 2", highest="a", lowest="z"),
        "midprice": _over("midprice", source=extremes, midprice="(hh + ll) / 2", highest_high="hh", lowest_low="ll"),
        "ecl": _over("ecl", **{k: f"CASE WHEN n >= 3 THEN {v} END" for k, v in ecl.items()}),
        "cdl_doji": _over("cdl_doji", signal=f"CASE WHEN {small} AND CASE WHEN {ls} > 0 AND {us} > 0 THEN least(abs({us} - {ls}) / {ls} * 100, abs({ls} - {us}) / {us} * 100) ELSE 100 END < 100 THEN 1 ELSE 0 END"),
        "cdl_dragonfly_doji": _over("cdl_dragonfly_doji", signal=f"CASE WHEN {small} AND {us} <= abs(close - open) THEN 100 ELSE 0 END"),
        "cdl_gravestone_doji": _over("cdl_gravestone_doji", signal=f"CASE WHEN {small} AND {ls} <= abs(close - open) THEN -100 ELSE 0 END"),
        "max": _over("max", max=full(f"max(close) OVER {w14}", 14)),
        "min": _over("min", min=full(f"min(close) OVER {w14}", 14)),
        "sum": _over("sum", sum=full(f"sum(close) OVER {w14}", 14)),
        "var": _over("var", **moments),
        "stddev": _over("stddev", **({"stddev": full(f"stddev_pop(close) OVER {w14}", 14)} | {k: moments[k] for k in ("sum", "sum_sq")})),
        "correl": _over("correl", correl=full(f"covar_pop(close, volume) OVER {w14} / nullif((stddev_pop(close) OVER {w14}) * (stddev_pop(volume) OVER {w14}), 0)", 14), sum_0=full(f"sum(close) OVER {w14}", 14), sum_1=full(f"sum(volume) OVER {w14}", 14), sum_0_sq=full(f"sum(close * close) OVER {w14}", 14), sum_1_sq=full(f"sum(volume * volume) OVER {w14}", 14), sum_01=full(f"sum(close * volume) OVER {w14}", 14)),
    }


def _chain(depth: int, period: int) -> list[str]:
    out = []
    for j in range(1, depth + 1):
        source, x = ("s", "close") if j == 1 else (f"e{j - 1}", "y")
        out.append(ema(f"e{j}", source, x, (j - 1) * (period - 1) + 1, period))
    return out


def _chained(name: str, depth: int, period: int, main: str, extra: int = 0) -> str:
    lookback = depth * (period - 1) + extra
    es = [f"e{j}" for j in range(1, depth + 1)]
    source = _joined(*es)
    if extra:
        source = f"(SELECT *, lag(e{depth}) OVER (PARTITION BY symbol ORDER BY rn) AS pe FROM {source}) u"
    return _sql(_chain(depth, period), source, _from(lookback, {name: main} | {f"ema{j}": f"e{j}" for j in range(1, depth + 1)}), name)


def _recursive_sql() -> dict[str, str]:
    v = 0.7
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2
    gains = "g AS MATERIALIZED (SELECT symbol, rn, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM s)"
    smoothed = {"smoothed_plus_dm": "p", "smoothed_minus_dm": "mi", "smoothed_tr": "r"}
    adx = [*_direction(14), wilder("x", "d", "dx", 15, 14)]
    with_adx = "(SELECT d.*, x.y AS adx FROM d LEFT JOIN x USING (symbol, rn)) t"
    atr = [MOVES, wilder("a", "m", "tr", 2, 14)]
    sar = """z AS (
  SELECT symbol, rn, high - ph >= pl - low AS up, CASE WHEN high - ph >= pl - low THEN pl ELSE ph END AS sar, 0.02::DOUBLE AS af,
    CASE WHEN high - ph >= pl - low THEN high ELSE low END AS ep, 1::BIGINT AS since
  FROM s WHERE rn = 2
  UNION ALL
  SELECT symbol, rn, CASE WHEN crossed THEN NOT up ELSE up END, CASE WHEN crossed THEN ep2 ELSE c END,
    CASE WHEN crossed THEN 0.02::DOUBLE ELSE af2 END, CASE WHEN NOT crossed THEN ep2 WHEN up THEN low ELSE high END, CASE WHEN crossed THEN rn - 2 ELSE since END
  FROM (
    SELECT *, CASE WHEN up THEN low < c ELSE high > c END AS crossed FROM (
      SELECT z.symbol, s.rn, z.up, z.since, s.high, s.low,
        CASE WHEN z.up AND s.rn - 1 - z.since < 2 THEN least(z.sar + z.af * (z.ep - z.sar), s.pl)
          WHEN z.up THEN least(z.sar + z.af * (z.ep - z.sar), s.pl, s.pl2)
          WHEN s.rn - 1 - z.since < 2 THEN greatest(z.sar + z.af * (z.ep - z.sar), s.ph)
          ELSE greatest(z.sar + z.af * (z.ep - z.sar), s.ph, s.ph2) END AS c,
        CASE WHEN z.up AND s.high > z.ep THEN s.high WHEN NOT z.up AND s.low < z.ep THEN s.low ELSE z.ep END AS ep2,
        CASE WHEN (z.up AND s.high > z.ep) OR (NOT z.up AND s.low < z.ep) THEN least(z.af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE z.af END AS af2
      FROM z JOIN s ON s.symbol = z.symbol AND s.rn = z.rn + 1))
)"""
    trend = [MOVES, wilder("a", "m", "tr", 2, 10), "k AS MATERIALIZED (SELECT s.symbol, s.rn, close, pc, a.y AS atr, (high + low) / 2 + 3 * a.y AS bu, (high + low) / 2 - 3 * a.y AS bl FROM s JOIN a USING (symbol, rn))", """z AS (
  SELECT symbol, rn, 100 AS trend, bu AS u, bl AS l FROM k WHERE rn = 11
  UNION ALL
  SELECT symbol, rn, CASE WHEN was = 100 THEN CASE WHEN close < l2 THEN -100 ELSE 100 END WHEN close > u2 THEN 100 ELSE -100 END, u2, l2 FROM (
    SELECT k.symbol, k.rn, k.close, z.trend AS was, CASE WHEN k.pc <= z.u THEN least(k.bu, z.u) ELSE k.bu END AS u2, CASE WHEN k.pc >= z.l THEN greatest(k.bl, z.l) ELSE k.bl END AS l2
    FROM z JOIN k ON k.symbol = z.symbol AND k.rn = z.rn + 1)
)"""]  # fmt: skip
    flow = "f AS MATERIALIZED (SELECT *, sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume) OVER (PARTITION BY symbol ORDER BY rn) AS ad FROM s)"
    ha = "h AS MATERIALIZED (SELECT *, CASE WHEN rn = 1 THEN (open + close) / 2 ELSE lag((open + high + low + close) / 4) OVER (PARTITION BY symbol ORDER BY rn) END AS x, (open + high + low + close) / 4 AS hc FROM s)"
    candle = "CASE WHEN rn < 14 THEN {warm} WHEN {cond} END"
    small = "body <= e AND body > 0"
    return {
        "ema": _sql([ema("e", "s", "close", 1, 14)], _joined("e"), {"ema": "e"}, "ema"),
        "rma": _sql([wilder("e", "s", "close", 1, 14)], _joined("e"), {"rma": "e"}, "rma"),
        "dema": _chained("dema", 2, 5, "2 * e1 - e2"),
        "tema": _chained("tema", 3, 3, "3 * e1 - 3 * e2 + e3"),
        "t3": _chained("t3", 6, 5, f"{c1!r}::DOUBLE * e6 + {c2!r}::DOUBLE * e5 + {c3!r}::DOUBLE * e4 + {c4!r}::DOUBLE * e3"),
        "trix": _chained("trix", 3, 3, "(e3 - pe) / nullif(pe, 0) * 100", 1),
        "macd": _sql([ema("ef", "s", "close", 1, 12), ema("es", "s", "close", 1, 26), "li AS MATERIALIZED (SELECT symbol, rn, ef.y - es.y AS y FROM ef JOIN es USING (symbol, rn))", ema("sg", "li", "y", 26, 9)], _joined("ef", "es", "sg"), _from(33, {"macd_line": "ef - es", "signal": "sg", "histogram": "ef - es - sg", "fast_ema": "ef", "slow_ema": "es"}), "macd"),
        "rsi": _sql([gains, wilder("gg", "g", "gain", 2, 14), wilder("gl", "g", "loss", 2, 14)], _joined("gg", "gl"), {"rsi": "CASE WHEN gl = 0 THEN 100 ELSE 100 - 100 / (1 + gg / nullif(gl, 0)) END", "avg_gain": "gg", "avg_loss": "gl"}, "rsi"),
        "plus_dm": _sql([MOVES, summed("e", "m", "plus", 14)], _joined("e"), {"plus_dm": "e"}, "plus_dm"),
        "minus_dm": _sql([MOVES, summed("e", "m", "minus", 14)], _joined("e"), {"minus_dm": "e"}, "minus_dm"),
        "plus_di": _sql(_direction(14), "d", _from(14, {"plus_di": "pdi", "smoothed_plus_dm": "p", "smoothed_tr": "r"}), "plus_di"),
        "minus_di": _sql(_direction(14), "d", _from(14, {"minus_di": "mdi", "smoothed_minus_dm": "mi", "smoothed_tr": "r"}), "minus_di"),
        "dx": _sql(_direction(14), "d", _from(14, {"dx": "dx"} | smoothed), "dx"),
        "adx": _sql(adx, with_adx, _from(27, {"adx": "adx"} | smoothed), "adx"),
        "adxr": _sql(adx, f"(SELECT *, lag(adx, 13) OVER (PARTITION BY symbol ORDER BY rn) AS pa FROM {with_adx}) u", _from(40, {"adxr": "(adx + pa) / 2", "adx": "adx"} | smoothed), "adxr"),
        "atr": _sql(atr, _joined("a"), {"atr": "a"}, "atr"),
        "natr": _sql(atr, _joined("a"), {"natr": "a / nullif(close, 0) * 100"}, "natr"),
        "sar": _sql([sar], "(SELECT s.symbol, s.ts, s.rn, z.sar, z.up, z.af, z.ep FROM s LEFT JOIN z USING (symbol, rn)) t", {"sar": "sar", "is_long": "coalesce(up, false)", "af": "coalesce(af, 0)", "ep": "ep"}, "sar"),
        "supertrend": _sql(trend, "(SELECT s.symbol, s.ts, s.rn, z.trend AS t0, z.u, z.l, a.y AS atr0 FROM s LEFT JOIN z USING (symbol, rn) LEFT JOIN a USING (symbol, rn)) t", {"supertrend": "CASE WHEN t0 = 100 THEN l ELSE u END", "trend": "coalesce(t0, 0)", "atr": "atr0", "upper": "u", "lower": "l"}, "supertrend"),
        "adosc": _sql([flow, ema("ef", "f", "ad", 1, 3), ema("es", "f", "ad", 1, 10)], "(SELECT f.*, ef.y AS ef, es.y AS es FROM f LEFT JOIN ef USING (symbol, rn) LEFT JOIN es USING (symbol, rn)) t", {k: f"CASE WHEN n > 9 THEN {e} END" for k, e in {"adosc": "ef - es", "ad": "ad", "fast_ema": "ef", "slow_ema": "es"}.items()}, "adosc"),
        "ha": _sql([ha, recurrence("o", "h", "x", 1, 1, "0.5::DOUBLE", "0.5::DOUBLE")], "(SELECT h.*, o.y AS o FROM h JOIN o USING (symbol, rn)) t", {k: f"CASE WHEN n > 1 THEN {e} END" for k, e in {"ha_open": "o", "ha_high": "CASE WHEN rn = 1 THEN high ELSE greatest(high, o, hc) END", "ha_low": "CASE WHEN rn = 1 THEN low ELSE least(low, o, hc) END", "ha_close": "hc"}.items()}, "ha"),
        "vegas": _sql([ema(f"v{p}", "s", "close", 1, p) for p in (144, 169, 576, 676)], _joined("v144", "v169", "v576", "v676"), {k: f"CASE WHEN n > 675{more} THEN {e} END" for k, e, more in (("channel_upper", "v144", " AND rn > 675"), ("channel_lower", "v169", ""), ("boundary_upper", "v576", ""), ("boundary_lower", "v676", ""))}, "vegas"),
        "cdl_hammer": _candle("cdl_hammer", candle.format(warm=-1, cond=f"{small} AND ls >= 2 * body AND us <= body AND least(open, close) > (high + low) / 2 THEN 100 ELSE 0")),
        "cdl_inverted_hammer": _candle("cdl_inverted_hammer", candle.format(warm=-1, cond=f"{small} AND us >= 2 * body AND ls <= body AND greatest(open, close) < (high + low) / 2 THEN 100 ELSE 0")),
        "cdl_long_shadow": _candle("cdl_long_shadow", candle.format(warm=-1, cond="body <= e AND us >= 0.75::DOUBLE * (high - low) AND NOT ls >= 0.75::DOUBLE * (high - low) THEN -100 WHEN body <= e AND ls >= 0.75::DOUBLE * (high - low) AND NOT us >= 0.75::DOUBLE * (high - low) THEN 100 ELSE 0")),
        "cdl_marubozu": _candle("cdl_marubozu", candle.format(warm=0, cond="body > pe AND us <= body * 5.0::DOUBLE / 100 AND ls <= body * 5.0::DOUBLE / 100 THEN CASE WHEN close > open THEN 100 ELSE -100 END ELSE 0")),
    }


def _rounded(out: DataFrame, name: str) -> DataFrame:
    op = CATALOG[name]
    # adding zero makes -0 a 0
    return out.select("symbol", "ts", *[(F.round(f"{name}_{o}", decimals(o)) + F.lit(0.0)).alias(f"{name}_{o}") if t == "double" else _plain(f"{name}_{o}", t) for o, t in op.outputs])


def stepped_query(name: str) -> Query:
    """The operator bar by bar: what a stream does with each bar, replayed over every series of daily bars."""
    op = CATALOG[name]
    i = indicator(name)

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        step = Incremental(name)
        rows = rows.sort_values("ts")
        bars = rows[list(i.inputs.values())].to_numpy(float)
        got = [step.step(**dict(zip(i.inputs, map(float, bar), strict=True))) for bar in bars]
        return rows[["symbol", "ts"]].assign(**{f"{name}_{o}": pd.Series([g[o] for g in got], index=rows.index, dtype=object) for o, _ in op.outputs})

    schema = "symbol string, ts string, " + ", ".join(f"{name}_{o} {t}" for o, t in op.outputs)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(sources.daily(spark, sf_dir).groupBy("symbol").applyInPandas(replay, schema), name)

    return run


def candle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The helpers over hourly bars of events."""
    series = Series()
    order = Window.partitionBy("symbol").orderBy("ts")
    b = sources.hourly_events(spark, sf_dir).withColumns({"rn": F.row_number().over(order), "po": F.lag("open").over(order), "pc": F.lag("close").over(order)})
    o, h, low, c, po, pc = (F.col(x) for x in ("open", "high", "low", "close", "po", "pc"))
    parts = {"body": helpers.real_body(o, c), "upper": helpers.upper_shadow(h, o, c), "lower": helpers.lower_shadow(low, o, c)}
    ages = {"since_high": helpers.highest_bars(h, F.col("rn"), series, 14), "since_low": helpers.lowest_bars(low, F.col("rn"), series, 14)}
    return b.select(
        "symbol", "ts", "volume", *[(F.round(x, 6) + F.lit(0.0)).alias(n) for n, x in parts.items()],
        *[F.coalesce(x, F.lit(False)).alias(n) for n, x in (("up", helpers.gap_up(o, c, po, pc)), ("down", helpers.gap_down(o, c, po, pc)))],
        *[x.cast("bigint").alias(n) for n, x in ages.items()], F.round(F.lit(helpers.period_to_k(14)), 6).alias("k"),
    )


CANDLE_PARTS = """
WITH b AS (
  SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
), s AS (
  SELECT *, row_number() OVER w AS rn, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)
)
SELECT symbol, ts, volume, round(abs(close - open), 6) + 0.0::DOUBLE AS body, round(high - greatest(open, close), 6) + 0.0::DOUBLE AS upper,
  round(least(open, close) - low, 6) + 0.0::DOUBLE AS lower, coalesce(least(open, close) > CASE WHEN po IS NOT NULL THEN greatest(po, pc) END, false) AS up,
  coalesce(greatest(open, close) < CASE WHEN po IS NOT NULL THEN least(po, pc) END, false) AS down,
  (rn - arg_max(rn, (high, rn)) OVER f)::BIGINT AS since_high, (rn - arg_min(rn, (low, -rn)) OVER f)::BIGINT AS since_low, round(2.0::DOUBLE / 15, 6) AS k
FROM s WINDOW f AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
"""


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.by_supplier(spark, sf_dir).withColumn("volume", F.round("volume", 6))


SUPPLIER_BARS = """
SELECT l_suppkey::VARCHAR AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS ts,
  arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_quantity))::DOUBLE AS open,
  max(l_extendedprice)::DOUBLE AS high, min(l_extendedprice)::DOUBLE AS low,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_quantity))::DOUBLE AS close,
  round(sum(l_quantity)::DOUBLE, 6) AS volume
FROM lineitem GROUP BY ALL
"""


def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series aligned by day, and their correlation."""
    pair = sources.aligned(sources.daily(spark, sf_dir), "AF", "RF")
    out = with_indicators(pair, [indicator("correl", inputs={"price": "price", "price2": "price2"})])
    return out.select("symbol", "ts", "price", "price2", (F.round("correl_correl", 3) + F.lit(0.0)).alias("correl"))


PAIR_CORRELATION = f"""
WITH {BARS}, p AS (
  SELECT x.ts, x.close AS price, y.close AS price2 FROM b x JOIN b y ON x.ts = y.ts WHERE x.symbol = 'AF' AND y.symbol = 'RF'
), c AS (
  SELECT *, count(*) OVER w AS n, covar_pop(price, price2) OVER w AS cov, stddev_pop(price) OVER w * stddev_pop(price2) OVER w AS dev FROM p WINDOW w AS (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
)
SELECT 'AF/RF' AS symbol, ts, price, price2, CASE WHEN n = 14 THEN round(cov / nullif(dev, 0), 3) + 0.0::DOUBLE END AS correl FROM c
"""


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL surface: the table function ``ta`` over daily bars."""
    register(spark)
    sources.daily(spark, sf_dir).createOrReplaceTempView("tidemark_daily")
    out = spark.sql("SELECT * FROM ta(TABLE(SELECT * FROM tidemark_daily) PARTITION BY (symbol) ORDER BY (ts), 'rsi', 'period=14')")
    return _rounded(out.withColumnsRenamed({o: f"rsi_{o}" for o, _ in CATALOG["rsi"].outputs}), "rsi")


#: In streams these have values before a series is long enough for its batch to have any.
EARLY = ("vegas", "ecl")


def queries() -> dict[str, Query]:
    stepped = {f"{name}_inc": stepped_query(name) for name in CATALOG}
    return {name: operator_query(name) for name in CATALOG} | stepped | {"candle_parts": candle_parts, "supplier_bars": supplier_bars, "pair_correlation": pair_correlation, "table_function": table_function}


def oracle_sql() -> dict[str, str]:
    out = _simple_sql() | _recursive_sql()
    stepped = {f"{name}_inc": sql for name, sql in out.items() if name not in EARLY}
    return out | stepped | {"candle_parts": CANDLE_PARTS, "supplier_bars": SUPPLIER_BARS, "pair_correlation": PAIR_CORRELATION, "table_function": out["rsi"]}

import pickle

import pytest
from pyspark.sql import functions as F

from tests.test_operators import frame, sample, walk
from tidemark import functions as T
from tidemark.operators import CATALOG, Average, indicator, moving_average
from tidemark.options import Options, Series
from tidemark.plans import with_indicators
from tidemark.streaming import Incremental


def test_candle_parts_and_gaps(spark):
    row = spark.createDataFrame([(10.0, 15.0, 8.0, 12.0, 9.0, 9.5)], "o double, h double, l double, c double, po double, pc double")
    o, h, low, c, po, pc = (F.col(x) for x in ("o", "h", "l", "c", "po", "pc"))
    got = row.select(T.real_body(o, c), T.upper_shadow(h, o, c), T.lower_shadow(low, o, c), T.gap_up(o, c, po, pc), T.gap_down(o, c, po, pc)).first()
    assert tuple(got) == (2, 3, 2, True, False) and T.period_to_k(14) == 2 / 15


def test_ages_of_extremes_take_the_latest(spark):
    df = frame(spark, {"a": walk(6, 1) | {"high": [3.0, 5.0, 5.0, 4.0, 1.0, 2.0], "low": [3.0, 1.0, 1.0, 4.0, 5.0, 6.0]}})
    n = F.col("ts") + 1
    got = df.select("ts", T.highest_bars(F.col("high"), n, Series(), 3).alias("h"), T.lowest_bars(F.col("low"), n, Series(), 3).alias("l")).orderBy("ts").collect()
    assert [r.h for r in got] == [0, 0, 0, 1, 2, 2] and [r.l for r in got] == [0, 0, 0, 1, 2, 2]


def test_incremental_equals_batch_bar_by_bar(spark):
    cols = walk(130, 3)
    names = [n for n in CATALOG if n not in ("vegas", "ecl")]
    rows = with_indicators(frame(spark, {"a": cols}), [indicator(n) for n in names]).orderBy("ts").collect()
    for name in names:
        step = Incremental(name)
        roles = indicator(name).inputs
        for k in range(130):
            if k == 60:
                step = Incremental.restored(step.state())
            out = step.step(**{r: cols[c][k] for r, c in roles.items()})
            for o, v in out.items():
                w = rows[k][f"{name}_{o}"]
                assert (v is None) == (w is None) and (v is None or abs(v - w) <= 1e-6 * max(1, abs(w))), (name, o, k)


def same(v, w):
    return (v is None) == (w is None) and (v is None or abs(v - w) <= 1e-6 * max(1, abs(w)))


ROLES = ("open", "high", "low", "close", "volume")


def test_nulls_in_every_role_mean_the_same_in_batch_and_stream(spark):
    """A null bar, in one role or all, at the start or later: row operators have no value there, frames none while
    they hold it, and what carries its own past none from there on; signals stay neutral."""
    series = {f"{r} {k}": (r, k) for r in (*ROLES, "all") for k in (0, 1, 40)}
    cols = {}
    for n, (name, (role, at)) in enumerate(series.items()):
        own = walk(60, 20 + n)
        for r in ROLES if role == "all" else (role,):
            own[r] = [None if k == at else v for k, v in enumerate(own[r])]
        cols[name] = own
    names = [n for n in CATALOG if n != "vegas"]
    small = {"wma": {"period": 7}, "trima": {"period": 7}, "bbands": {"period": 7}, "sma": {"period": 35}, "max": {"period": 40}}
    inds = [indicator(n, **small.get(n, {})) for n in names]
    df = frame(spark, cols)
    got = {(r.symbol, r.ts): r for r in with_indicators(df, inds).collect()}
    for name, own in cols.items():
        for i in inds:
            step = Incremental(i.operator.name, **i.params)
            for k in range(60):
                for o, v in step.step(**{r: own[c][k] for r, c in i.inputs.items()}).items():
                    assert same(v, got[name, k][f"{i.prefix}_{o}"]), (name, i.prefix, o, k, v, got[name, k][f"{i.prefix}_{o}"])
    after = got["all 40", 59]
    assert [after[c] for c in ("ad_ad", "obv_obv", "vwap_vwap", "adosc_adosc", "ema_ema", "sar_sar", "sar_is_long", "supertrend_supertrend")] == [None] * 8
    assert after.supertrend_trend == 0 and after.rocp_rocp is not None and after.wma_wma is not None and after.max_max is None
    assert got["all 40", 40].medprice_medprice is None and got["all 40", 41].medprice_medprice is not None


def test_ecl_and_vegas_bar_by_bar(spark):
    """Once their least length is reached, streams and batches agree."""
    own = walk(700, 8)
    rows = with_indicators(frame(spark, {"a": own}), [indicator("ecl"), indicator("vegas")]).orderBy("ts").collect()
    for name, start in (("ecl", 0), ("vegas", 675)):
        step = Incremental(name)
        for k in range(700):
            out = step.step(**{r: own[c][k] for r, c in indicator(name).inputs.items()})
            assert k < start or all(same(v, rows[k][f"{name}_{o}"]) for o, v in out.items()), (name, k)


def test_long_frames_have_the_values_of_short_ones(spark, monkeypatch):
    """The same operators as columns and in the Arrow hop."""
    from tidemark.operators import expressions

    ops = ["sma", "trima", "mfi", "stoch", "willr", "aroon", "bbands", "adr", "midpoint", "midprice", "max", "min", "sum", "var", "stddev", "correl", "mom", "roc"]
    df = frame(spark, {"a": walk(120, 4), "b": walk(20, 5)})
    inds = [indicator(n, period=25) if "period" in CATALOG[n].params else indicator(n) for n in ops]
    plans = []
    for longest in (100, 1):
        monkeypatch.setattr(expressions, "LONGEST_FRAME", longest)
        plans.append(with_indicators(df, inds).orderBy("symbol", "ts").collect())
    for a, b in zip(*plans, strict=True):
        assert all(same(a[c], b[c]) if not isinstance(a[c], str) else a[c] == b[c] for c in a.asDict()), (a, b)


def test_incremental_checks_its_bar():
    with pytest.raises(ValueError):
        Incremental("atr").step(high=1.0, low=1.0)
    with pytest.raises(ValueError):
        Incremental("nothing")
    assert isinstance(pickle.loads(Incremental("sar").state()), Incremental)


def test_moving_average_by_kind(spark):
    assert Average.WMA == 9 and moving_average().operator.name == "sma"
    assert moving_average("t3", period=4).params == {"period": 4, "vfactor": 0.7}
    with pytest.raises(ValueError):
        moving_average(Average.KAMA)


def test_precision_nan_check_and_strictness(spark):
    df = frame(spark, {"a": sample(), "b": walk(5, 1)})
    out = with_indicators(df, [indicator("aroon"), indicator("sar")], options=Options(precision="single"))
    assert dict(out.dtypes)["aroon_aroon_up"] == "float" and dict(out.dtypes)["aroon_days_since_low"] == "int" and dict(out.dtypes)["sar_is_long"] == "boolean"
    with pytest.raises(ValueError, match="rows"):
        with_indicators(df, [indicator("sma")], options=Options(strict=True))
    with_indicators(df, [indicator("sma", period=5)], options=Options(strict=True, check_nan=True))
    with pytest.raises(ValueError, match="NaN in close"):
        with_indicators(df.withColumn("close", F.lit(float("nan"))), [indicator("sma")], options=Options(check_nan=True))


def test_other_keys_and_roles(spark):
    df = frame(spark, {"a": sample()}).select(F.lit("x").alias("exchange"), F.col("symbol").alias("sym"), F.col("ts").alias("at"), F.col("close").cast("decimal(12,2)").alias("px"))
    series = Series(("exchange", "sym"), "at", {"close": "px"})
    got = with_indicators(df, [indicator("sma"), indicator("ema")], series).orderBy("at").collect()
    assert abs(got[13].sma_sma - 35203.53571428572) < 1e-6 and abs(got[14].ema_ema - 35188.437619047625) < 1e-5

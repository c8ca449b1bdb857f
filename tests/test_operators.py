"""Golden values, edge cases, and agreement of columns, kernels, streams and SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import helpers as H
from tidemark.operators import CATALOG, indicator, lookback
from tidemark.operators.arrays import stepper
from tidemark.options import Options
from tidemark.plans import with_indicators
from tidemark.plans.sql import register

ROLES = ("open", "high", "low", "close", "volume")


def frame(spark, series):
    """series: {symbol: {role: list}}"""
    rows = [(s, k, *[cols[r][k] if cols[r] is not None else None for r in ROLES]) for s, cols in series.items() for k in range(len(cols["close"]))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")


def sample(n=30):
    return {"open": (H.OPEN + H.CLOSE39)[:n], "high": H.HIGH[:n], "low": H.LOW[:n], "close": H.CLOSE[:n], "volume": H.VOLUME[:n]}


def walk(n, seed, flat=0.0):
    r = random.Random(seed)
    out = {k: [] for k in ROLES}
    c = 100.0
    for _ in range(n):
        o = c
        c = round(max(1.0, o + r.uniform(-2, 2)), 2) if r.random() >= flat else o
        h, low = (round(max(o, c) + r.uniform(0, 1), 2), round(min(o, c) - r.uniform(0, 1), 2)) if r.random() >= flat else (max(o, c), min(o, c))
        for k, v in zip(ROLES, (o, h, low, c, float(r.randrange(0, 500)))):
            out[k].append(v)
    return out


def column(spark, series, name, output, **params):
    df = with_indicators(frame(spark, {"a": series}), [indicator(name, "x", **params)])
    return [r[0] for r in df.orderBy("ts").select(f"x_{output}").collect()]


def close_to(got, want, tolerance):
    assert len(got) >= len(want)
    for g, w in zip(got, want):
        assert g is not None and abs(g - w) <= tolerance, (g, w)


GOLDEN = [
    ("sma", "sma", 13, [35203.53571428572, 35194.55, 35181.67857142857, 35168.00714285715, 35156.821428571435, 35148.78571428572], 1e-6),
    ("ema", "ema", 13, [35203.53571428572, 35188.437619047625, 35168.80593650794, 35146.205144973545, 35128.49779231041], 1e-5),
    ("rsi", "rsi", 14, [37.74834437086139, 34.22353836122586, 31.518806080459882, 33.4255686324182, 40.465006259629995], 1e-5),
    ("atr", "atr", 14, [63.1857142857147, 66.37244897959243, 68.60298833819287, 67.52420345689339, 67.45104606711529], 1e-4),
    ("adx", "adx", 27, [23.383153393338485, 22.136715365358942, 21.473716847015616], 1e-5),
    ("sar", "sar", 1, [35266.0, 35264.81, 35261.4176, 35253.574544, 35130.7, 35133.246], 1e-4),
    ("supertrend", "supertrend", 10, [35014.05, 35021.590000000004, 35043.585999999996, 35043.585999999996, 35043.585999999996], 1e-5),
]


@pytest.mark.parametrize("name,output,first,want,tolerance", GOLDEN)
def test_golden_values(spark, name, output, first, want, tolerance):
    got = column(spark, sample(), name, output)
    assert all(v is None for v in got[:first])
    close_to(got[first:], want, tolerance)


#: Operator, output, index of the first value, and the values there, at default parameters.
MORE_GOLDEN = [
    ("wma", "wma", 29, [35086.70666666667]),
    ("dema", "dema", 8, [35218.82903703704, 35200.55518792867, 35185.33845633287, 35207.88230269776, 35210.681534115734]),
    ("tema", "tema", 6, [35209.88333333334, 35245.56666666668, 35206.03020833333, 35184.88072916666, 35173.01927083332]),
    ("t3", "t3", 24, [34990.33089268528, 35014.01040657281, 35039.64008514726, 35061.489687430236, 35075.56340616185]),
    ("trima", "trima", 29, [35106.67916666667]),
    ("mom", "mom", 14, [-125.8, -180.2, -191.4, -156.6, -112.5]),
    ("roc", "roc", 14, [-0.3572229747189404, -0.5116207760055058, -0.5438936991875476, -0.4452658515780472, -0.31977033384023024]),
    ("rocp", "rocp", 10, [-0.0011642402196722522, 0.00024133055471957387, 0.0006194818517393206, -0.0002644299118567788, -0.00259227150633137]),
    ("rocr", "rocr", 10, [0.9988357597803278, 1.0002413305547195, 1.0006194818517393, 0.9997355700881432, 0.9974077284936687]),
    ("rocr100", "rocr100", 10, [99.88357597803278, 100.02413305547195, 100.06194818517393, 99.97355700881431, 99.74077284936686]),
    ("trix", "trix", 7, [0.02360056575074765, 0.007581993206917659, -0.008943588952370352, -0.019561690627645234, -0.0022332060023777522]),
    ("cci", "cci", 13, [-94.08289072334637, -180.80279232111462, -244.06355715019887, -243.8483838237473, -166.79021576587272]),
    ("mfi", "mfi", 14, [30.01466135506106, 23.918092608653822, 19.69886843882211, 28.25691647089976, 33.13531787852985]),
    ("stoch", "k", 17, [13.888595327554674, 23.274994970831596, 25.819754576544284, 20.205422372883813, 12.265381731365673]),
    ("stoch", "d", 17, [11.330297439346538, 15.45781338781021, 20.99444829164352, 23.100057306753232, 19.43018622693126]),
    ("willr", "willr", 13, [-80.10610079575635, -94.93545183713789, -92.281105990784, -85.15389257694503, -80.89921544960693]),
    ("bop", "bop", 0, [-0.7414829659318422, 0.1268292682927894, -0.5511669658887965, -0.3444259567386869, 0.40845070422527996]),
    ("plus_dm", "plus_dm", 13, [155.09999999999854, 144.0214285714272, 133.73418367346812, 124.18174198250611, 115.31161755518424]),
    ("minus_dm", "minus_dm", 13, [165.0, 217.01428571428863, 260.51326530612516, 312.90517492711626, 290.5548052894651]),
    ("dx", "dx", 14, [20.21762785636671, 32.15723575657665, 43.17755248291567, 43.17755248291565, 23.711947860846085]),
    ("aroon", "aroon_up", 14, [50.0, 42.85714285714286, 35.714285714285715, 28.571428571428573, 21.42857142857143]),
    ("aroon", "aroon_down", 14, [100.0, 100.0, 100.0, 92.85714285714286, 85.71428571428572]),
    ("aroonosc", "aroonosc", 14, [-50.0, -57.142857142857146, -64.28571428571429, -64.28571428571429, -64.28571428571429]),
    ("bbands", "upper", 19, [35315.49215816903, 35324.02352034893, 35323.82218647993, 35319.44964708179, 35314.110592229015]),
    ("bbands", "middle", 19, [35154.365000000005, 35140.535, 35127.095, 35117.560000000005, 35111.15000000001]),
    ("bbands", "lower", 19, [34993.23784183098, 34957.04647965108, 34930.367813520075, 34915.67035291822, 34908.189407771]),
    ("adr", "adr", 2, [48.866666666666184, 52.26666666666764, 48.06666666666812, 57.26666666667006, 57.33333333333576]),
    ("ad", "ad", 0, [-1055.365, -1262.0153804877511, -1682.083847274164, -1313.3930070079768, -902.4219506699479]),
    ("obv", "obv", 0, [1055.365, 1811.853, 1129.701, -68.046, 357.924]),
    ("medprice", "medprice", 0, [35241.05, 35227.0, 35207.85, 35160.75, 35167.8]),
    ("wclprice", "wclprice", 0, [35228.575, 35224.2, 35199.275, 35165.375, 35174.65]),
    ("midpoint", "midpoint", 13, [35207.65, 35172.45, 35147.9, 35126.95, 35126.95]),
    ("midprice", "midprice", 13, [35206.1, 35180.8, 35151.3, 35115.8, 35115.8]),
    ("max", "max", 13, [35254.6, 35254.6, 35254.6, 35254.6, 35254.6]),
    ("min", "min", 13, [35160.7, 35090.3, 35041.2, 34999.3, 34999.3]),
    ("sum", "sum", 13, [492849.50000000006, 492723.70000000007, 492543.50000000006, 492352.10000000003, 492195.50000000006]),
    ("var", "var", 13, [786.2937245368958, 1610.1553571224213, 3072.7173981666565, 5255.849234580994, 6837.828826189041]),
    ("stddev", "stddev", 13, [28.040929452086566, 40.126741172470275, 55.43209718355112, 72.49723604787285, 82.69116534545296]),
]


def test_more_golden_values(spark):
    names = sorted({name for name, *_ in MORE_GOLDEN})
    rows = with_indicators(frame(spark, {"a": sample()}), [indicator(n) for n in names]).orderBy("ts").collect()
    for name, output, first, want in MORE_GOLDEN:
        got = [r[f"{name}_{output}"] for r in rows]
        assert all(v is None for v in got[:first]), name
        close_to(got[first:], want, 1e-4)


def test_every_operator_agrees_with_its_kernel_in_any_chunks(spark):
    """Columns of a batch against kernels fed bar by bar and in pieces; several series at once."""
    series = {"a": walk(900, 1), "b": walk(700, 2, 0.4), "c": walk(20, 3), "d": walk(1, 4)}
    inds = [indicator(n) for n in CATALOG]
    rows = {}
    for r in with_indicators(frame(spark, series), inds).collect():
        rows.setdefault(r.symbol, []).append(r)
    for s, cols in series.items():
        got = sorted(rows[s], key=lambda r: r.ts)
        n = len(got)
        for i in inds:
            op = i.operator
            if op.name in ("vegas", "adosc", "ha", "ecl") and n <= max(lookback(op.name), 2):
                assert all(r[f"{op.name}_{o}"] is None for r in got for o, _ in op.outputs), op.name
                continue
            cuts = sorted({0, n, *random.Random(n).sample(range(n + 1), min(n, 9))})
            state, parts = stepper(op.name, i.params), {o: [] for o, _ in op.outputs}
            for lo, hi in zip(cuts, cuts[1:]):
                out = state({r: np.array(cols[c][lo:hi], float) for r, c in i.inputs.items()})
                for o in parts:
                    parts[o] += out[o].tolist()
            for o, t in op.outputs:
                for k in range(n):
                    g, w = got[k][f"{op.name}_{o}"], parts[o][k]
                    if t == "double":
                        w = w if math.isfinite(w) else None
                    assert (g is None) == (w is None) and (g is None or abs(g - w) <= 1e-6 * max(1, abs(w))), (op.name, o, s, k, g, w)


def test_first_value_is_at_the_lookback(spark):
    n = 760
    got = with_indicators(frame(spark, {"a": walk(n, 5)}), [indicator(x) for x in CATALOG]).orderBy("ts").collect()
    for name, op in CATALOG.items():
        main, kind = op.outputs[0]
        if kind != "double" or name == "ha":
            continue
        first = next(k for k in range(n) if got[k][f"{name}_{main}"] is not None)
        assert first == lookback(name), name


def test_one_shuffle_and_one_python_hop(spark):
    df = with_indicators(frame(spark, {"a": sample()}), [indicator(n) for n in CATALOG])
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1 and initial.count("MapInArrow") == 1


def test_no_python_for_columns(spark):
    # wma and cci need every value of their frame: a list in each row, or the hop
    names = [n for n, o in CATALOG.items() if o.kind != "recursive" and n not in ("wma", "cci")]
    assert len(names) == 34
    plan = with_indicators(frame(spark, {"a": sample()}), [indicator(n) for n in names])._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_flat_bars(spark):
    n = 60
    flat = {r: [50.0] * n for r in ROLES} | {"volume": [0.0] * n}
    names = ("bop", "ad", "willr", "stoch", "cci", "plus_di", "dx", "rsi", "stddev", "correl", "bbands", "vwap", "mfi", "cdl_doji")
    last = with_indicators(frame(spark, {"a": flat}), [indicator(x) for x in names]).orderBy(F.desc("ts")).first()
    want = {"bop_bop": 0, "ad_ad": 0, "willr_willr": 0, "stoch_fast_k": 50, "cci_cci": 0, "plus_di_plus_di": 0, "dx_dx": None, "rsi_rsi": 100, "stddev_stddev": 0, "correl_correl": None, "bbands_upper": 50, "bbands_lower": 50, "vwap_vwap": 0, "mfi_mfi": 0, "cdl_doji_signal": 0}
    assert {k: last[k] for k in want} == want


def test_ties_zero_prices_nan_and_null(spark):
    s = walk(40, 9)
    s["high"] = [10.0, 12.0, 12.0, 11.0] * 10
    up = column(spark, s, "aroon", "days_since_high", period=3)
    assert up[6] == 0 and up[7] == 1 and up[8] == 2
    z = walk(10, 9)
    z["close"] = [0.0, 5.0] + z["close"][2:]
    assert column(spark, z, "roc", "roc", period=1)[1] is None
    z["close"][5] = float("nan")
    z["close"][8] = None
    assert [v is None for v in column(spark, z, "sma", "sma", period=2)] == [True, False, False, False, False, True, True, False, True, True]
    assert all(v is None for v in column(spark, z, "ema", "ema", period=2)[5:])


def test_parameters_are_checked():
    for bad in (("sma", {"period": 1}), ("macd", {"fast_period": 26, "slow_period": 12}), ("sar", {"acceleration": 0.3}), ("supertrend", {"multiplier": 0}), ("roc", {"period": 0}), ("ema", {"periods": 3}), ("kama", {})):
        with pytest.raises(ValueError):
            indicator(bad[0], **bad[1])
    with pytest.raises(ValueError):
        Options(warmup="zero")
    assert lookback("macd") == 33 and lookback("t3", period=5) == 24 and lookback("adxr", period=14) == 40


def test_clashing_columns_are_refused_and_nan_warmup(spark):
    df = frame(spark, {"a": sample()})
    with pytest.raises(ValueError):
        with_indicators(df, [indicator("sma"), indicator("sma", period=5)])
    out = with_indicators(df, [indicator("sma", "s5", period=5), indicator("ema", "e", k=0.5, period=3)], options=Options("nan")).orderBy("ts").first()
    assert math.isnan(out.s5_sma) and math.isnan(out.e_ema)


def test_table_function(spark):
    register(spark)
    series = {"a": walk(80, 1), "b": walk(50, 2)}
    df = frame(spark, series)
    df.createOrReplaceTempView("bars")
    want = {(r.symbol, r.ts): r for r in with_indicators(df, [indicator("macd"), indicator("aroon")]).collect()}
    got = spark.sql("SELECT * FROM ta(TABLE(bars) PARTITION BY (symbol) ORDER BY (ts), 'macd', 'fast_period=12, slow_period=26, signal_period=9')").collect()
    assert len(got) == 130
    for r in got:
        w = want[r.symbol, r.ts]
        assert (r.signal is None) == (w.macd_signal is None) and (r.signal is None or abs(r.signal - w.macd_signal) < 1e-9)
    for r in spark.sql("SELECT * FROM ta(TABLE(bars) PARTITION BY (symbol) ORDER BY (ts), 'aroon')").collect():
        assert r.days_since_high == want[r.symbol, r.ts].aroon_days_since_high


def test_empty_table(spark):
    assert with_indicators(frame(spark, {"a": sample()}).limit(0), [indicator(n) for n in CATALOG]).count() == 0

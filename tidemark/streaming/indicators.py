"""Indicators over a stream of bars: keyed state holds each operator's kernel, so every bar costs one step.

The kernels are those of batches; the values of any prefix of a series are the batch's values of it.
Within a micro-batch bars are put in order; a bar that is not later than the last one of its series is
late, and left out. State survives restarts and lost executors through the query's checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.arrays import stepper
from tidemark.operators.catalog import Indicator
from tidemark.options import Series

#: The setting and value that keyed state of this kind needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Processor(StatefulProcessor):
    def __init__(self, plan: list[tuple[str, dict, dict, tuple, str]], order: str, columns: list[str]):
        self.plan, self.order, self.columns = plan, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernels", StructType().add("kernels", "binary").add("last", "binary"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = pd.concat(list(rows)).sort_values(self.order, kind="stable").drop_duplicates(self.order, keep="first")
        if self.state.exists():
            kernels, last = self.state.get()
            states, last = pickle.loads(kernels), pickle.loads(last)
            bars = bars[bars[self.order] > last]
        else:
            states = [stepper(name, params) for name, params, _, _, _ in self.plan]
        if not len(bars):
            return
        bars = bars.reset_index(drop=True)
        out = bars[self.columns].copy()
        for state, (_, _, cols, outs, prefix) in zip(states, self.plan, strict=True):
            got = state({r: bars[c].astype(float).to_numpy() for r, c in cols.items()})
            for n, t in outs:
                v = got[n]
                out[f"{prefix}_{n}"] = np.where(np.isfinite(v), v, np.nan) if t == "double" else pd.Series(v.tolist(), dtype=object)
        self.state.update((pickle.dumps(states), pickle.dumps(bars[self.order].iloc[-1])))
        yield out

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, indicators: Iterable[Indicator], series: Series | None = None) -> DataFrame:
    """The bars with the indicators' columns, in append mode. The session needs STATE_STORE."""
    series = series or Series()
    indicators = list(indicators)
    plan = [(i.operator.name, i.params, {r: series.column(c) for r, c in i.inputs.items()}, i.operator.outputs, i.prefix) for i in indicators]
    named = [(n, t) for i in indicators for n, t in i.columns()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema), *(f"`{n}` {t}" for n, t in named)])
    processor = _Processor(plan, series.order, bars.columns)
    return bars.groupBy(*series.keys).transformWithStateInPandas(processor, schema, "Append", "None")


def bar_stream(ticks: DataFrame, symbol: str, time: str, price: str, volume: str, tie: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of a stream of ticks, complete once the watermark has passed them. ``tie`` orders ticks of one time."""
    at = F.struct(F.col(time).alias("t"), F.col(tie).alias("k"))
    return (
        ticks.withWatermark(time, late)
        .groupBy(F.col(symbol).alias("symbol"), F.window(time, width).alias("w"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, at).alias("close"), F.sum(volume).cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )

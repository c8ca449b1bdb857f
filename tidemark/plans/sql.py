"""Indicators from SQL: ``SELECT * FROM ta(TABLE(bars) PARTITION BY (symbol) ORDER BY (ts), 'ema', 'period=14')``.

The table function returns the partition's symbol, ts and the operator's outputs. It holds a chunk of
rows, never a series. For many indicators at once, with_indicators shares one pass among them.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from tidemark.operators.arrays import stepper
from tidemark.operators.catalog import Indicator, indicator

CHUNK = 2048
_TYPES = {"double": DoubleType(), "bigint": LongType(), "boolean": BooleanType()}


def parsed(name: str, given: str | None) -> Indicator:
    """``given``: settings like "period=14, price=high"; names of roles choose columns."""
    params: dict[str, Any] = {}
    inputs: dict[str, str] = {}
    for part in filter(None, (x.strip() for x in (given or "").split(","))):
        key, _, value = (x.strip() for x in part.partition("="))
        try:
            params[key] = int(value)
        except ValueError:
            try:
                params[key] = float(value)
            except ValueError:
                inputs[key] = value
    return indicator(name, inputs=inputs, **params)


class TableFunction:
    @staticmethod
    def analyze(table: AnalyzeArgument, name: AnalyzeArgument, settings: AnalyzeArgument | None = None) -> AnalyzeResult:
        i = parsed(name.value, settings.value if settings else None)
        known = {f.name: f.dataType for f in table.dataType.fields}
        missing = {*i.inputs.values(), "symbol", "ts"} - known.keys()
        if missing:
            raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
        schema = StructType().add("symbol", known["symbol"]).add("ts", known["ts"])
        for n, t in i.operator.outputs:
            schema = schema.add(n, _TYPES[t])
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.held: list[Row] = []
        self.state = None

    def eval(self, row: Row, name: str, settings: str | None = None):  # noqa: ANN201
        if self.state is None:
            self.indicator = parsed(name, settings)
            self.state = stepper(name, self.indicator.params)
        self.held.append(row)
        if len(self.held) >= CHUNK:
            yield from self._flush()

    def _flush(self):  # noqa: ANN202
        rows, self.held = self.held, []
        if not rows:
            return
        x = {r: np.array([np.nan if v[c] is None else float(v[c]) for v in rows]) for r, c in self.indicator.inputs.items()}
        out = self.state(x)
        columns = []
        for n, t in self.indicator.operator.outputs:
            if t == "double":
                columns.append([float(v) if np.isfinite(v) else None for v in out[n]])
            else:
                columns.append([v if v is None or t == "boolean" else int(v) for v in out[n].tolist()])
        for row, *values in zip(rows, *columns, strict=True):
            yield (row["symbol"], row["ts"], *values)

    def terminate(self):  # noqa: ANN201
        yield from self._flush()


def register(spark: SparkSession, name: str = "ta") -> None:
    spark.udtf.register(name, udtf(TableFunction))

"""Many indicators in one pass: one shuffle and sort by series, one window column set for each depth,
and at most one Arrow hop for all recursive operators and long frames together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import arrays, expressions, kernels
from tidemark.operators.catalog import Indicator
from tidemark.options import Options, Series

_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def in_columns(i: Indicator) -> bool:
    """Whether the indicator is made of columns alone, without the Arrow hop."""
    longest = i.operator.lookback(**i.params) if i.operator.kind == "window" and "period" in i.params else 0
    return i.operator.name in expressions.BUILDERS and longest <= expressions.LONGEST_FRAME


def with_indicators(df: DataFrame, indicators: Iterable[Indicator], series: Series | None = None, options: Options | None = None) -> DataFrame:
    """The rows with the indicators' columns, named prefix_output."""
    series, options = series or Series(), options or Options()
    indicators = list(indicators)
    named = [n for i in indicators for n, _ in i.columns()]
    clash = {n for n in named if named.count(n) > 1} | set(named) & set(df.columns)
    if clash:
        raise ValueError(f"columns {', '.join(sorted(clash))} come twice; give the indicators other prefixes")
    inputs = {i.prefix: {r: series.column(c) for r, c in i.inputs.items()} for i in indicators}
    _check(df, indicators, inputs, series, options)
    steps = expressions.Steps(series)
    outputs = {}
    for i in indicators:
        if in_columns(i):
            built = expressions.build(steps, i.operator.name, inputs[i.prefix], i.params)
            outputs |= {f"{i.prefix}_{n}": built[n].cast(t) for n, t in i.operator.outputs}
    recursive = [i for i in indicators if not in_columns(i)]
    if recursive:
        steps.columns["__number"] = (0, F.row_number().over(steps.order()))
        if any(i.operator.name in kernels.NEED_LENGTH for i in recursive):
            steps.columns["__count"] = (0, F.count(F.lit(1)).over(Window.partitionBy(*series.keys)))
    own = df.columns
    out = df
    for depth in range(steps.deepest + 1):
        if columns := steps.at(depth):
            out = out.withColumns(columns)
    extra = [c for c in ("__number", "__count") if c in steps.columns]
    keep = [F.col(f"`{c}`") for c in [*own, *extra]]
    out = out.select(*keep, *[c.alias(n) for n, c in outputs.items()])
    if recursive:
        out = _recursive(out, recursive, inputs, extra)
    out = out.select(*[F.col(f"`{c}`") for c in own], *named)
    if options.warmup == "nan":
        doubles = {n for i in indicators for n, t in i.columns() if t == "double"}
        out = out.withColumns({n: F.coalesce(n, F.lit(float("nan"))) for n in doubles})
    if options.precision == "single":
        narrow = {"double": "float", "bigint": "int"}
        out = out.withColumns({n: F.col(n).cast(narrow[t]) for i in indicators for n, t in i.columns() if t in narrow})
    return out


def _check(df: DataFrame, indicators: list[Indicator], inputs: dict[str, dict[str, str]], series: Series, options: Options) -> None:
    if options.check_nan:
        columns = sorted({c for cols in inputs.values() for c in cols.values()})
        found = df.agg(*[F.count_if(F.isnan(F.col(f"`{c}`").cast("double"))).alias(c) for c in columns]).first()
        if bad := [c for c in columns if found[c]]:
            raise ValueError(f"NaN in {', '.join(bad)}")
    if options.strict and indicators:
        most = max(i.operator.lookback(**i.params) for i in indicators)
        short = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most).limit(1).collect()
        if short:
            raise ValueError(f"a series has {short[0]['__n']} rows; {most + 1} are needed")


def as_floats(column: pa.Array) -> np.ndarray:
    if not pa.types.is_floating(column.type):
        column = column.cast(pa.float64(), safe=False)
    return column.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float)


def as_arrow(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "double":
        return pa.array(np.where(np.isfinite(values), values, np.nan), pa.float64(), from_pandas=True)
    return pa.array(values.tolist() if values.dtype == object else values, _ARROW[kind])


def _recursive(df: DataFrame, indicators: list[Indicator], inputs: dict[str, dict[str, str]], extra: list[str]) -> DataFrame:
    """The rows come from a window by series, so each partition holds whole series, in order; a series
    starts where its row number is 1. State is carried from batch to batch, so no series need fit in memory."""
    plan = [(i.operator.name, i.params, inputs[i.prefix], i.operator.outputs, i.operator.lookback(**i.params)) for i in indicators]
    named = [(n, t) for i in indicators for n, t in i.columns()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[kernels.Kernel] = []
        for b in batches:
            starts = np.flatnonzero(b.column("__number").to_numpy() == 1).tolist()
            cuts = sorted({0, *starts, b.num_rows})
            counts = b.column("__count").to_numpy() if "__count" in extra else None
            floats = {c: as_floats(b.column(c)) for _, _, cols, _, _ in plan for c in cols.values()}
            parts: list[list[np.ndarray]] = [[] for _ in named]
            first = set(starts)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo in first:
                    states = [arrays.stepper(name, params) for name, params, _, _, _ in plan]
                at = 0
                for state, (name, _, cols, outs, lookback) in zip(states, plan, strict=True):
                    got = state({r: floats[c][lo:hi] for r, c in cols.items()})
                    short = name in kernels.NEED_LENGTH and counts[lo] <= lookback
                    for n, _ in outs:
                        parts[at].append(np.full(hi - lo, np.nan) if short else got[n])
                        at += 1
            columns = [as_arrow(np.concatenate(p) if p else np.zeros(0), t) for p, (_, t) in zip(parts, named, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *[n for n, _ in named]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {t}" for n, t in named)])
    return df.mapInArrow(run, schema)

"""Connected components by alternating large-star and small-star rounds.

Each task first writes down, for the edges it has, a forest that connects the same vertices. Forests of LOCAL
edges or fewer, all tasks' together, are then joined by one task, as rounds over so few edges would cost many
stages and nothing else; larger ones go through the rounds.

Each round is grouping with partial sums (minima) and a sort-merge join back, so a vertex with many
edges is no hot group, and its table is written to the shared folder. Rounds are logarithmic in the
number of vertices in practice; nothing but the number of changes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, give_back, holding, written

#: Edges that a task holds at once.
LOCAL = 500_000


def stars(edges: pa.Table) -> pa.Table:
    """u, v: every vertex of these edges but the least of each component, with that least one."""
    both = pa.concat_arrays([*edges.column("u").chunks, *edges.column("v").chunks]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    x, y = rank[both.indices.to_numpy(zero_copy_only=False)].reshape(2, -1)
    root = np.arange(len(order))
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        # the larger of two roots hangs on the smaller
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    u = np.flatnonzero(root != np.arange(len(root)))
    return pa.table([both.dictionary.take(pa.array(order[k])) for k in (u, root[u])], ["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    holding("components")
    held: list[pa.RecordBatch] = []
    for b in batches:
        if sum(x.num_rows for x in held) + b.num_rows > LOCAL:
            yield from stars(pa.Table.from_batches(held)).to_batches() if held else ()
            held = []
        if b.num_rows:
            held.append(b)
    if held:
        yield from stars(pa.Table.from_batches(held)).to_batches()
    give_back()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """v, root: every vertex with the least vertex that it is connected to."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    e = written(e.mapInArrow(_forest, schema), "component-edges")
    n = e.count()
    if n <= LOCAL:
        joined = written(e.coalesce(1).mapInArrow(_forest, schema), "component-edges")
        discard(e)
        e = joined
    for _ in range(most_rounds if n > LOCAL else 0):
        # large-star: what is larger than u hangs on u's least neighbour (or u)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # as a table of its own: a join right above the aggregate could not split a vertex of many edges
        least = written(least, "component-least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "component-large")
        discard(least)
        # small-star: u and what is smaller than u hang on u's least neighbour
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "component-least")
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "component-edges")
        # stars: every u once, no v that hangs on something
        loose = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).unionByName(
            new.select("v").join(new.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u"), F.lit(1).cast("long").alias("n")).limit(1)
        )
        settled = not loose.take(1)
        discard(e, large, least)
        e = new
        if settled:
            break
    else:
        if n > LOCAL:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())

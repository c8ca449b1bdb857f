"""Small inputs with the awkward cases that every operator must take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, texts, first=0):
    rows = [(None if k == "null" else k, x, "en", "s", len(x) if x is not None else None) for k, x in (texts if isinstance(texts, list) and texts and isinstance(texts[0], tuple) else list(enumerate(texts, first)))]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size):x}{r.choice(['a', 'é', 'tion', ''])}" for _ in range(n)]


def prose(n, seed, size=400, per_line=12):
    w = words(n, seed, size)
    return ".\n".join(" ".join(w[k : k + per_line]) for k in range(0, n, per_line))

"""The corpus pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination and
piece encoding, each over all that the stage before it kept.

All stages but the last return the columns of documents. Quality rules drop the documents they reject;
line dedup rewrites ``text`` (and ``n_chars``, where a line went) and drops documents that it leaves
without a word; the join keeps the first document of every group; decontamination drops documents with
a window of any benchmark item; encoding adds the ids of the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_dedup, piece_dropout, quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(docs, out="__lines")
    cut = F.col("__lines.n_removed") > 0
    new = {"text": F.col("__lines.text"), "n_chars": F.when(cut, F.length("__lines.text")).otherwise(F.col("n_chars"))}
    worded = F.col("__lines.text").rlike("[^\\x00-\\x20]")
    return done.where(~cut | worded).select(*[(new[c].cast(t) if c in new else F.col(f"`{c}`")).alias(c) for c, t in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = piece_dropout.encode_docs(docs, public_tokenizers.path("piece_bpe_32k.model"), out="__pieces")
    return out.select("doc_id", "lang", "source", "__pieces.variant", "__pieces.n_tokens", "__pieces.lossless", "__pieces.ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("piece_dropout", pieces),
]

#: Expectation-maximisation and keyed merge-dropout are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, without writing between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

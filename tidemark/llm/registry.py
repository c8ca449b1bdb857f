"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidemark.llm import decontaminate, jaccard_join, license_scan, line_dedup, perplexity, piece_dropout, quality_rules, suffix_dedup, token_files, toxicity
from tidemark.llm.common import shared_dir
from tidemark.llm.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = "__quality"
    return quality_rules.quality_rules(docs, columns=["doc_id"]).select(
        "doc_id", *[f"{q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], F.round(f"{q}.posterior", 6).alias("posterior")
    )


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.perplexities(docs, table(spark, sf_dir, "labels"), out="m").select("doc_id", "m.n_words", "m.perplexity", "m.threshold", "m.kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), toxicity.fold(F.col("doc_id")) != 0)
    score = F.col("score")
    return toxicity.score(docs, model, out="score").select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (score >= 0.5).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), "text", "h")
    n_items = F.size("h.items").cast("long")
    return found.select(
        "doc_id",
        "h.n_words",
        decontaminate.n_hit("h.spans").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("h.items"), ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, out="d").select("doc_id", "d.n_lines", "d.n_removed", "d.n_runs", F.sha2(F.coalesce("d.text", F.lit("")), 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_digests(spark, path)


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_dropout.encode_docs(docs, model, out="p", keep_ids=False).select("doc_id", "p.variant", "p.n_tokens", "p.ids_crc32", "p.lossless")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_groups(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links", "group_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.license_scan(docs, out="s").select(
        "doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word",
        F.array_join("s.labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("s.labels", "s.found")), ",").alias("labels"),
        "s.score",
    )


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_perplexity": op2_perplexity,
        "op3_toxicity": op3_toxicity,
        "op4_decontaminate": op4_decontaminate,
        "op5_line_dedup": op5_line_dedup,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_token_files": op7_token_files,
        "op8_piece_dropout": op8_piece_dropout,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_license_scan": op10_license_scan,
    }

"""The registered queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction, near_dedup, quality, topk, toxicity, warc
from .common import table
from .decontamination import contaminated
from .packing import packed
from .substring_dedup import deduplicated
from .token_counts import token_counts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).selectExpr("doc_id", "held_out", "score", "predicted", "cast(size(passages) as int) as n_passages")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.searched(rows, rows.where("vec_id % 100 = 0"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_topk": op4_topk,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_extraction": op9_extraction,
    "op10_substring_dedup": op10_substring_dedup,
}

#: DuckDB's form of those queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": near_dedup.SQL,
    "op3_warc": warc.SQL,
    "op4_topk": topk.SQL,
}

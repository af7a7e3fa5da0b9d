"""The corpus pipeline: documents through five operators, each stage's table written and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import quality
from prosemill.llm.common import among, table, written
from prosemill.llm.decontamination import contaminated
from prosemill.llm.near_dedup import near_duplicates
from prosemill.llm.packing import packed
from prosemill.llm.substring_dedup import deduplicated
from prosemill.session import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, predicts to be good."""
    ship(spark)
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, keep=True).where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    Of rows that repeat an id and a text, or an id within a group, one stays. A row without an id goes if its text is
    linked with one that has an id. Documents without words are in no group and stay.
    """
    ship(spark)
    found = written(near_duplicates(docs, k=5, percent=80, more=True), "near")
    grouped = found.where("kept and group_id is not null").groupBy("group_id", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = grouped.groupBy("group_id").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("marks"))
    others = grouped.join(first.where("marks > 1"), "group_id").where("mark <> first.mark").select("doc_id", "mark")
    dropped = found.where("not kept and component_id is not null").select("doc_id", "mark").unionByName(others)
    repeated = grouped.where("n > 1").select("doc_id", "mark")
    at = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    left = among(docs, dropped, at, kept=False)
    if repeated.isEmpty():
        return left
    once = among(left, repeated, at).withColumn("__mark", at[1]).dropDuplicates(["doc_id", "__mark"]).drop("__mark")
    return among(left, repeated, at, kept=False).unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without bytes that repeat 50-byte strings of documents with smaller ids; n_chars follows the text.

    Documents of which nothing but white space stays go.
    """
    ship(spark)
    cut = deduplicated(docs, keep_text=True)
    # an untouched text stays as it is, null too
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    left = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S")).withColumns({"text": text, "n_chars": n_chars})
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; a null id goes with any other whose text holds one."""
    ship(spark)
    hits = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return among(docs, hits.select("doc_id"), [F.col("doc_id").cast("long")], kept=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens that all documents fill."""
    ship(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the token ids: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs

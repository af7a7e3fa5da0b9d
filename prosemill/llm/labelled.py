"""A bounded sample of labelled rows, the one thing that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most max_rows labelled documents (text, label) that may be learnt from.

    The rows are those whose ids hash lowest, so the choice depends on neither order nor partitions. Ids, labels or
    texts that are null and held-out rows are left out; of an id with several labels the largest counts. The chosen
    labels number max_rows at most, which bounds the broadcast.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    usable = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(chosen), "id").select("text", "label")

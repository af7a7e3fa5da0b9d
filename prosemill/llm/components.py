"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_path


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("u", "m")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each end of an edge reaches, itself included.

    Each round is a few aggregations and joins by node; a round's edges are written to the shared folder, so that
    lineage stays short and a lost executor costs a round at most. No node's neighbours are gathered in one place.
    Edges with a null end and loops are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    root = shared_path(spark, "components")
    now = _kept(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{root}/0")
    mark, step = None, 0
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark, step = (seen.n, seen.h), step + 1
        now = _kept(_small(_large(now)), f"{root}/{step}")
        if step > 1:
            removed(spark, f"{root}/{step - 2}")
    # the fixed point is stars: every other node beside its component's smallest
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return stars.union(stars.select("component", "component")).distinct()

"""The drift log of a corpus: findings by tier of each run, and what changed since the run before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entry(findings: DataFrame, version: str, timestamp: str) -> DataFrame:
    """One row: timestamp, version, tier1, tier2, tier3."""
    tiers = [F.coalesce(F.sum((F.col("tier") == t).cast("long")), F.lit(0)).alias(f"tier{t}") for t in (1, 2, 3)]
    return findings.agg(*tiers).select(F.lit(timestamp).alias("timestamp"), F.lit(version).alias("version"), "tier1", "tier2", "tier3")


def append(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", "true").csv(path)


def changes(log: DataFrame) -> DataFrame:
    """Each run with its differences to the run before; the log has a row a run, so one task orders it."""
    w = Window.orderBy("timestamp")
    return log.select("timestamp", "version", *[(F.col(f"tier{t}").cast("long") - F.lag(F.col(f"tier{t}").cast("long")).over(w)).alias(f"d_tier{t}") for t in (1, 2, 3)])

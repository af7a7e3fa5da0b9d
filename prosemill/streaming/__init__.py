"""Streams of documents: scans are stateless, so a stream takes the batch plan; rates of findings use watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Embedder
from ..plans.engine import scan
from ..rules.model import Ruleset, Settings


def scan_stream(docs: DataFrame, ruleset: Ruleset, settings: Settings | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Findings of a stream of (path, text) documents, for append mode."""
    return scan(docs, ruleset, settings, embedder=embedder)


def finding_rate(findings: DataFrame, time_col: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Findings by time window and tier of rows that carry a timestamp; rows later than the watermark drop out."""
    return findings.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), "tier").agg(F.count("*").alias("n"))

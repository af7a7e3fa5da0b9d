"""The engine's DataFrame operations.

Every operation on documents is one Arrow crossing a batch: all scanners of a document run in one Python function, with
the compiled ruleset in its closure. There is no shuffle before the ordered sink, so the same plan serves streams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import build_regions
from ..functions import stats as stat_functions
from ..functions.eol import normalize
from ..operators.rewrite import fix as fix_text
from ..operators.scan import Embedder, Scanner
from ..plugins import Plugin
from ..rules.model import LEVELS, STATS, Ruleset, Settings
from ..session import ship

FINDINGS = (
    "path string, rule_id string, kind string, tier int, category string, start int, `end` int, line int, col int, excerpt string, message string, "
    "replacement string, advice string, url struct<text:string,href:string>, context string, anchorless boolean"
)
_URL = pa.struct([("text", pa.string()), ("href", pa.string())])
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, *[pa.string()] * 4, _URL, pa.string(), pa.bool_()]
_NAMES = ["path", "rule_id", "kind", "tier", "category", "start", "end", "line", "col", "excerpt", "message", "replacement", "advice", "url", "context", "anchorless"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scan(docs: DataFrame, ruleset: Ruleset, settings: Settings | None = None, plugins: Sequence[tuple[Plugin, dict[str, Any]]] = (), embedder: Embedder | None = None) -> DataFrame:
    """Findings of (path, text) documents, a document's in order: start, end, tier, rule. Null texts are empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ruleset, settings, plugins, embedder)
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for f in scanner.scan(text.as_py())[0]:
                    url = {"text": f.url[0], "href": f.url[1]} if f.url else None
                    rows.append((path, f.rule_id, f.kind, f.tier, f.category, f.start, f.end, f.line, f.col, f.excerpt, f.message, f.replacement, f.advice, url, f.context, f.anchorless))
            yield _batch(rows)

    return _texts(docs).mapInArrow(run, FINDINGS)


def warnings(docs: DataFrame, ruleset: Ruleset, settings: Settings | None = None, plugins: Sequence[tuple[Plugin, dict[str, Any]]] = (), embedder: Embedder | None = None) -> DataFrame:
    """(path, warning) of scans that skipped a plugin or a repetition rule."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ruleset, settings, plugins, embedder)
        for b in batches:
            rows = [(path, w) for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for w in scanner.scan(text.as_py())[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "warning"])

    return _texts(docs).mapInArrow(run, "path string, warning string")


def ordered(findings: DataFrame) -> DataFrame:
    """The sink's order, over all documents."""
    return findings.orderBy("path", "start", "end", "tier", "rule_id", "message")


def ordered_lines(lines: DataFrame) -> DataFrame:
    """The same order for rendered lines."""
    return lines.orderBy("path", "start", "end", "tier", "rule_id")


def doc_stats(docs: DataFrame) -> DataFrame:
    """One row a document: word, sentence and item counts and every statistic, null below its floor."""
    ship(docs.sparkSession)
    names = [s for s in STATS if s != "term_cluster_max"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stat_functions.compute(build_regions(normalize(x.as_py()).text)) for x in b.column(1)]
            counts = [pa.array([getattr(d, n) for d in found], pa.int64()) for n in ("word_count", "sentence_count", "bullet_count")]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *(pa.array([d.get(s) for d in found], pa.float64()) for s in names)], names=["path", "word_count", "sentence_count", "bullet_count", *names])

    return _texts(docs).mapInArrow(run, "path string, word_count long, sentence_count long, bullet_count long, " + ", ".join(f"{s} double" for s in names))


def fix(docs: DataFrame, ruleset: Ruleset, settings: Settings | None = None) -> DataFrame:
    """(path, text, fixed, applied, overlapped, unfixable): the rewritten text of each document; nothing is written in place."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ruleset, settings)
        for b in batches:
            done = [fix_text(x.as_py(), scanner.scan(x.as_py())[0]) for x in b.column(1)]
            counts = [pa.array([getattr(d, n) for d in done], pa.int32()) for n in ("applied", "overlapped", "unfixable")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([d.text for d in done], pa.string()), *counts], names=["path", "text", "fixed", "applied", "overlapped", "unfixable"])

    return _texts(docs).mapInArrow(run, "path string, text string, fixed string, applied int, overlapped int, unfixable int")


def fix_summary(fixed: DataFrame) -> DataFrame:
    """One row: findings applied, skipped for overlap, unfixable, and files changed. Untouched documents' overlaps don't count."""
    changed = F.col("applied") > 0
    return fixed.agg(F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"), F.coalesce(F.sum(F.when(changed, F.col("overlapped"))), F.lit(0)).alias("skipped_overlaps"), F.coalesce(F.sum("unfixable"), F.lit(0)).alias("unfixable"), F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("files_changed"))


def blocking(findings: DataFrame) -> bool:
    """Whether any finding isn't a density one: the exit code's 1."""
    return not findings.where("tier < 3").limit(1).isEmpty()


def rule_listing(spark: SparkSession, ruleset: Ruleset, settings: Settings | None = None, plugins: Sequence[tuple[Plugin, dict[str, Any]]] = ()) -> DataFrame:
    """(id, tier, kind, category, level, has_advice) of every rule, entries of a group each, then plugins."""
    settings = settings or Settings()
    names = {v: k for k, v in LEVELS.items() if v}
    rows = []
    for g in ruleset.groups:
        for rule, advice in [(e.id, e.advice) for e in g.entries] or [(g.id, g.advice)]:
            level = settings.level(g.id, rule)
            level = "allow" if not g.enabled or level == "allow" else level or names[g.tier]
            rows.append((rule, LEVELS.get(level) or g.tier, g.kind, g.category, level, advice is not None))
    rows += [(p.id, p.tier, "plugin", p.category, settings.level(p.id) or names[p.tier], False) for p, _ in plugins]
    return spark.createDataFrame(rows, "id string, tier int, kind string, category string, level string, has_advice boolean")


def tier_tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tier").agg(F.count("*").alias("n"))

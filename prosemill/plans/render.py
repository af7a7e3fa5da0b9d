"""Sinks: JSON and GitHub annotation lines as columns, and a human report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..rules.model import LoadError
from .truncate import window

_SEVERITY = {1: "error", 2: "warning", 3: "note"}


def json_lines(findings: DataFrame) -> DataFrame:
    """(path, start, line) one compact JSON object a finding, fields in a fixed order; url and context only if present."""
    span = F.struct("start", "end", "line", "col")
    fields = [F.col(c) for c in ("rule_id", "kind", "tier", "category", "path")] + [span.alias("span")] + [F.col(c) for c in ("excerpt", "message", "replacement", "advice")]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    more = F.concat(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(","), F.expr(f"substring(to_json(struct({c})), 2, length(to_json(struct({c}))) - 2)"))).otherwise("") for c in ("url", "context")])
    return findings.withColumns({"__json": text, "__more": more}).select("path", "start", "end", "tier", "rule_id", F.concat(F.expr("substring(__json, 1, length(__json) - 1)"), F.col("__more"), F.lit("}")).alias("json"))


def _data(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _property(c: Column) -> Column:
    return F.replace(F.replace(_data(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def github_lines(findings: DataFrame) -> DataFrame:
    """Workflow annotations: ::error, ::warning or ::notice by tier, with the advice as a second message line."""
    word = F.when(F.col("tier") == 1, "error").when(F.col("tier") == 2, "warning").otherwise("notice")
    lines = F.size(F.split("excerpt", "\n"))
    last = F.element_at(F.split("excerpt", "\n"), -1)
    end_col = F.when(lines > 1, F.length(last) + 1).otherwise(F.col("col") + F.length("excerpt"))
    message = F.concat(F.col("message"), F.coalesce(F.concat(F.lit("\nhelp: "), F.col("advice")), F.lit("")))
    text = F.concat(F.lit("::"), word, F.lit(" file="), _property(F.col("path")), F.lit(",line="), F.col("line"), F.lit(",col="), F.col("col"), F.lit(",endLine="), F.col("line") + lines - 1, F.lit(",endColumn="), end_col, F.lit(",title="), _property(F.col("rule_id")), F.lit("::"), _data(message))
    return findings.select("path", "start", "end", "tier", "rule_id", text.alias("annotation"))


def human(rows: Iterable[Row], sources: dict[str, str], width: int = 0) -> str:
    """Diagnostics with the source lines and carets under each line of the span, cut to a width; findings of a stretch
    have no carets and two lines at most, those of a whole document no lines."""
    out = []
    for r in rows:
        out.append(f"{_SEVERITY[r.tier]}[{r.rule_id}]: {r.message}")
        if (r.start, r.end) != (0, 0):
            out.append(f"  --> {r.path}:{r.line}:{r.col}")
            lines, parts = sources.get(r.path, "").split("\n"), r.excerpt.split("\n")
            for k, part in enumerate(parts[:2] if r.anchorless else parts):
                line = lines[r.line - 1 + k] if r.line - 1 + k < len(lines) else ""
                at = r.col - 1 if not k else 0
                shown, before, size = window(line, at, at + len(part), width)
                out.append(f"{r.line + k:>5} {'│' if r.anchorless else '|'} {shown}")
                if not r.anchorless:
                    out.append("      | " + " " * before + "^" * size)
            if r.anchorless and len(parts) > 2:
                out.append("      │ …")
        out += [f"      = {name}: {value}" for name, value in (("help", r.advice), ("note", r.context), ("see", f"{r.url.text} - {r.url.href}" if r.url else None)) if value]
        out.append("")
    return "\n".join(out)


def load_errors(errors: Iterable[LoadError]) -> str:
    """Errors of rule packs under the file that each is in, by line."""
    by_path: dict[str, list[LoadError]] = {}
    for e in errors:
        by_path.setdefault(e.path, []).append(e)
    out = []
    for path, found in by_path.items():
        out.append(f"error: {path}: {len(found)} problem{'s' * (len(found) > 1)}")
        out += [f"  {f'line {e.line}: ' if e.line else ''}{e.message}" for e in sorted(found, key=lambda e: e.line or 0)]
    return "\n".join(out)

"""Reads rule packs. All errors are gathered; a ruleset comes out only if there are none."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from pathlib import Path

from . import fixtures, literals, policy, template
from .dedup import deduplicated
from .model import KINDS, SCOPES, STATS, VARIANTS, WINDOWS, Entry, Group, LoadError, LoadErrors, Metric, Repetition, Ruleset
from .stems import expand

_GROUP = {"id-base": str, "kind": str, "tier": int, "category": str, "message": str, "advice": str, "enabled": bool, "scope": str, "url": dict, "fixtures": dict, "entries": list, "stat": str, "per-words": int, "threshold-gt": float, "threshold-lt": float, "window": str, "terms": list, "variant": str, "threshold": float, "min-members": int, "max-distance": int}
_ENTRY = {"slug": str, "id": str, "advice": str, "message": str, "category": str, "terms": list, "stems": bool, "word_boundary": bool, "replacement": str, "regex": str, "captures": str, "engine": str}
_METRIC_KEYS = ("stat", "per-words", "threshold-gt", "threshold-lt", "window", "terms")
_REPETITION_KEYS = ("variant", "threshold", "min-members", "max-distance")


class _Reader:
    def __init__(self, path: str):
        self.path, self.errors, self.groups = path, [], []

    def error(self, message: str, line: int | None = None) -> None:
        self.errors.append(LoadError(self.path, message, line))

    def fields(self, where: str, table: dict, known: dict) -> dict:
        """The table with names in one spelling; unknown names and wrong types are errors."""
        out = {}
        for name, value in table.items():
            key = name if name in known else name.replace("_", "-")
            if key not in known:
                self.error(f"{where}: unknown field `{name}`")
                continue
            kind = known[key]
            if kind is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if not isinstance(value, kind) or kind is int and isinstance(value, bool):
                self.error(f"{where}: `{name}` must be a {kind.__name__}")
                continue
            out[key] = value
        return out

    def read(self, text: str) -> None:
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            line = re.search(r"line (\d+)", str(e))
            self.error(str(e), int(line[1]) if line else None)
            return
        for name in data.keys() - {"group"}:
            self.error(f"unknown field `{name}`")
        for k, table in enumerate(data.get("group", ())):
            self.group(k, self.fields(f"group[{k}]", table, _GROUP))

    def group(self, k: int, t: dict) -> None:
        before, where = len(self.errors), t.get("id-base", f"group[{k}]")
        for name in ("id-base", "kind", "tier", "category"):
            if name not in t:
                self.error(f"group[{k}]: `{name}` is required")
        kind = t.get("kind")
        if kind is not None and kind not in KINDS:
            self.error(f"{where}: unknown kind {kind!r}")
        if t.get("tier", 1) not in (1, 2, 3):
            self.error(f"{where}: tier {t['tier']} is not 1, 2 or 3")
        if t.get("scope", "prose") not in SCOPES:
            self.error(f"{where}: unknown scope {t['scope']!r}")
        if kind != "metric":
            for name in _METRIC_KEYS:
                if name in t:
                    self.error(f"{where}: `{name}` is for metric rules")
        if kind != "repetition":
            for name in _REPETITION_KEYS:
                if name in t:
                    self.error(f"{where}: `{name}` is for repetition rules")
        metric = self.metric(where, t) if kind == "metric" else None
        repetition = self.repetition(where, t) if kind == "repetition" else None
        entries = []
        if kind in ("metric", "repetition"):
            if t.get("entries"):
                self.error(f"{where}: {kind} rules must not carry [[entries]]")
            allowed = ("value", "per_words", "stat", "window") if kind == "metric" else ("count", "variant")
            for name in ("message", "advice"):
                for why in template.problems(t.get(name, ""), allowed):
                    self.error(f"{where}: {name}: {why}")
        elif kind in KINDS:
            entries = self.entries(where, kind, t)
        if len(self.errors) > before:
            return
        url = t.get("url")
        scope = t.get("scope", "prose" if kind in ("vocab", "pattern") else "anywhere")
        group = Group(t["id-base"], kind, t["tier"], t["category"], t.get("message"), t.get("advice"), t.get("enabled", True), scope, (url.get("text", "learn more"), url.get("href", "")) if url is not None else None, entries, metric, repetition)
        for why in fixtures.failures(group, list(t.get("fixtures", {}).get("must_match", ())), list(t.get("fixtures", {}).get("must_not_match", ()))):
            self.error(f"{where}: {why}")
        if len(self.errors) == before:
            self.groups.append(group)

    def metric(self, where: str, t: dict) -> Metric | None:
        stat, window = t.get("stat"), t.get("window", "paragraph")
        if stat not in STATS:
            self.error(f"{where}: unknown stat {stat!r}" if stat else f"{where}: metric rule requires `stat`")
        cutoffs = [d for d in ("gt", "lt") if f"threshold-{d}" in t]
        if len(cutoffs) != 1:
            self.error(f"{where}: exactly one of threshold-gt and threshold-lt is needed")
        if window not in WINDOWS:
            self.error(f"{where}: unknown window {window!r}")
        terms = [x for x in t.get("terms", ()) if isinstance(x, str)]
        if stat == "term_cluster_max" and not terms:
            self.error(f"{where}: term_cluster_max requires `terms`")
        if stat != "term_cluster_max" and terms:
            self.error(f"{where}: `terms` are for term_cluster_max")
        if stat not in STATS or len(cutoffs) != 1:
            return None
        surface: dict[str, int] = {}
        for lemma, term in enumerate(terms):
            for form in expand(term):
                surface.setdefault(form, lemma)
        return Metric(stat, cutoffs[0], t[f"threshold-{cutoffs[0]}"], t.get("per-words", 1000), window, tuple(surface), tuple(surface.values()))

    def repetition(self, where: str, t: dict) -> Repetition | None:
        variant, threshold = t.get("variant"), t.get("threshold")
        if variant not in VARIANTS:
            self.error(f"{where}: unknown variant {variant!r}" if variant else f"{where}: repetition rule requires `variant`")
        if threshold is None:
            self.error(f"{where}: repetition rule requires `threshold`")
        elif not 0 < threshold <= 1:
            self.error(f"{where}: repetition threshold {threshold} is not in (0, 1]")
        if t.get("max-distance", 1) < 1:
            self.error(f"{where}: repetition max-distance must be at least 1")
        if variant not in VARIANTS or threshold is None:
            return None
        return Repetition(variant, threshold, t.get("min-members", VARIANTS[variant]), t.get("max-distance", 200))

    def entries(self, where: str, kind: str, t: dict) -> list[Entry]:
        out, seen = [], set()
        for k, table in enumerate(t.get("entries", ())):
            e = self.fields(f"{where} entries[{k}]", table, _ENTRY)
            slug = e.get("slug") or e.get("id") or ""
            if not slug:
                self.error(f"{where}: entries[{k}] needs a non-empty `slug`")
                continue
            if slug in seen:
                self.error(f"{where}: duplicate entry slug `{slug}`")
            seen.add(slug)
            terms, names = [x for x in e.get("terms", ()) if isinstance(x, str)], ["match"]
            if kind == "pattern":
                if not e.get("regex"):
                    self.error(f"{where}: entry `{slug}`: pattern entries need `regex`")
                    continue
                try:
                    names = list(policy.compiled(e["regex"]).groupindex)
                except (ValueError, re.error) as why:
                    self.error(f"{where}: entry `{slug}`: {why}")
                    continue
            elif not terms:
                self.error(f"{where}: entry `{slug}`: {kind} entries need `terms`")
                continue
            if e.get("replacement") is not None and len(terms) != 1:
                self.error(f"{where}: entry `{slug}`: `replacement` requires exactly one term")
            if kind == "literal-ban":
                for term in terms:
                    try:
                        literals.compiled(term)
                    except ValueError as why:
                        self.error(f"{where}: entry `{slug}`: {why}")
            if kind == "vocab":
                terms = list(dict.fromkeys(f for x in terms for f in (expand(x) if e.get("stems") and len(x.strip()) >= 3 else [x.strip().lower()])))
            for name in ("message", "advice"):
                for why in template.problems(e.get(name, ""), names):
                    self.error(f"{where}: entry `{slug}`: {name}: {why}")
            out.append(Entry(f"{t.get('id-base', '')}#{slug}", terms, e.get("regex", "").strip() or None, e.get("word_boundary", True), e.get("replacement"), e.get("message", t.get("message")), e.get("advice", t.get("advice")), e.get("category")))
        if not out and not t.get("entries"):
            self.error(f"{where}: {kind} rules need [[entries]]")
        return out


def packs(paths: Iterable[str | Path]) -> list[Path]:
    """Pack files: files as they are, folders as all *.toml beneath, by file name."""
    found: list[Path] = []
    for p in map(Path, paths):
        found += sorted(p.rglob("*.toml"), key=lambda x: (x.name, str(x))) if p.is_dir() else [p]
    return found


def starter() -> Path:
    """The folder of the packs that come with the package."""
    return Path(__file__).resolve().parent.parent / "starter_rules"


def load_text(sources: Iterable[tuple[str, str]], embedder: bool = True) -> Ruleset:
    """A ruleset from (path, TOML text) pairs; LoadErrors names everything wrong.

    Without an embedder an enabled propositional group is an error. Ids must be unique over all packs. Groups end up
    deduplicated and sorted by id.
    """
    errors: list[LoadError] = []
    groups: list[Group] = []
    for path, text in sources:
        reader = _Reader(path)
        reader.read(text)
        errors += reader.errors
        for group in reader.groups:
            if any(g.id == group.id for g in groups):
                errors.append(LoadError(path, f"duplicate id-base `{group.id}`"))
            elif not embedder and group.enabled and group.repetition and group.repetition.variant == "propositional":
                errors.append(LoadError(path, f"{group.id}: propositional repetition needs an embedder"))
            else:
                groups.append(group)
    if errors:
        raise LoadErrors(errors)
    out = deduplicated(Ruleset(groups))
    odd = sorted({t for g in out.groups if g.kind == "vocab" for e in g.entries for t in e.terms if re.search(r"[^\w\s'’]", t)})
    out.warnings += [f"vocab: `{t}` holds punctuation and can't match word by word" for t in odd]
    out.groups.sort(key=lambda g: g.id)
    return out


def load(paths: Iterable[str | Path] | None = None, embedder: bool = True) -> Ruleset:
    """A ruleset from pack files and folders, the starter packs by default."""
    found, errors = [], []
    for path in packs(paths if paths is not None else [starter()]):
        try:
            found.append((str(path), path.read_text("utf-8")))
        except (OSError, UnicodeDecodeError) as e:
            errors.append(LoadError(str(path), str(e)))
    if errors:
        raise LoadErrors(errors)
    return load_text(found, embedder)

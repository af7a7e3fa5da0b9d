"""Scans one document by a ruleset: literals, patterns, vocabulary, statistics, clusters, repetition, plugins.

Offsets are characters of the normalised text until a finding is made; findings carry UTF-8 bytes of the original.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from ..functions import stats as stat_functions
from ..functions.eol import Normalized, byte_offsets, line_col, normalize
from ..functions.markdown import Regions, build_regions, mask_quoted
from ..functions.words import components, content_words, jaccard, lcs_ratio, lower_runs, paragraphs, sentence_units, sentences, shingles, token_positions, tokens, tokens_between
from ..plugins import Envelope, Plugin, PluginError
from ..rules import literals, policy, template
from ..rules.model import DEFAULT_MESSAGES, Entry, Group, Repetition, Ruleset, Settings

#: Similarity of words in order that makes sentences near-verbatim whatever the rule's threshold; that of the
#: near-verbatim groups that hide propositional ones; least words of a unit by variant.
LCS_BAR, VERBATIM_BAR, UNIT_WORDS = 0.6, 0.55, {"near-verbatim": 7, "propositional": 6}
EXCERPT = 80
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass
class Finding:
    rule_id: str
    kind: str
    tier: int
    category: str
    start: int
    end: int
    message: str
    advice: str | None = None
    replacement: str | None = None
    url: tuple[str, str] | None = None
    context: str | None = None
    anchorless: bool = False
    line: int = 1
    col: int = 1
    excerpt: str = ""


class Scanner:
    """A ruleset prepared once for many documents."""

    def __init__(self, ruleset: Ruleset, settings: Settings | None = None, plugins: Sequence[tuple[Plugin, dict[str, Any]]] = (), embedder: Embedder | None = None):
        self.rules, self.settings, self.plugins, self.embedder = ruleset, settings or Settings(), list(plugins), embedder
        s = self.settings
        self.dictionary = {t for g in ruleset.groups for e in g.entries if g.kind == "vocab" for t in e.terms}
        # vocabulary ignores max_tier, and an entry's own level can bring back an allowed group's entry
        self.vocabulary: dict[str, list[tuple[Group, Entry]]] = {}
        for g in ruleset.groups:
            for e in g.entries if g.kind == "vocab" and g.enabled else ():
                if s.level(g.id, e.id) != "allow":
                    for term in e.terms:
                        self.vocabulary.setdefault(" ".join(term.split()), []).append((g, e))
        self.longest = max((t.count(" ") + 1 for t in self.vocabulary), default=1)
        self.heads = {t.split(" ")[0] for t in self.vocabulary if " " in t}
        self.starts = {t.split(" ")[0] for t in self.vocabulary}
        self.literals = [(g, e, [literals.compiled(t) for t in e.terms]) for g in ruleset.groups if g.kind == "literal-ban" and s.live(g) for e in g.entries if s.level(g.id, e.id) != "allow"]
        # equal sources run once and serve all their owners
        owners: dict[str, list[tuple[Group, Entry]]] = {}
        for g in ruleset.groups:
            for e in g.entries if g.kind == "pattern" and s.live(g) else ():
                if s.level(g.id, e.id) != "allow":
                    owners.setdefault(e.regex, []).append((g, e))
        self.patterns = [(policy.compiled(source), held) for source, held in owners.items()]
        self.metrics = [g for g in ruleset.groups if g.metric and s.live(g)]
        self.repetitions = [g for g in ruleset.groups if g.repetition and s.live(g)]
        self.surfaces = {g.id: re.compile("|".join(rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])" for t in sorted(g.metric.terms, key=len, reverse=True))) for g in self.metrics if g.metric.terms}

    def scan(self, source: str) -> tuple[list[Finding], list[str]]:
        """All findings in order, and warnings."""
        return _Document(self, source).run()


class _Document:
    def __init__(self, scanner: Scanner, source: str):
        self.s, self.source, self.norm = scanner, source, normalize(source)
        self.regions: Regions = mask_quoted(build_regions(self.norm.text), scanner.dictionary)
        self.found: list[Finding] = []
        self.warnings: list[str] = []

    def run(self) -> tuple[list[Finding], list[str]]:
        for one in (self.literal, self.pattern, self.vocab, self.metric, self.repetition, self.plugin):
            one()
        order = sorted(range(len(self.found)), key=lambda k: (self.found[k].start, self.found[k].end, self.found[k].tier, self.found[k].rule_id, k))
        found = [self.found[k] for k in order]
        offsets = byte_offsets(self.source, sorted({p for f in found for p in (f.start, f.end)}))
        for f in found:
            f.line, f.col = line_col(self.source, f.start)
            f.excerpt = self.source[f.start : f.end]
            f.start, f.end = offsets[f.start], offsets[f.end]
        return found, self.warnings

    def entry(self, group: Group, entry: Entry, start: int, end: int, values: dict[str, str]) -> None:
        if self.s.settings.honor_scope and group.scope in ("heading", "list-item") and self.regions.scope_at(start) != group.scope:
            return
        show = values.get
        self.found.append(
            Finding(entry.id, group.kind, self.s.settings.tier(group, entry.id), entry.category or group.category, *self.norm.span(start, end), template.render(entry.message, show) if entry.message is not None else DEFAULT_MESSAGES[group.kind], template.render(entry.advice, show) if entry.advice is not None else None, entry.replacement if group.kind == "vocab" else None, group.url)
        )

    def group(self, group: Group, span: tuple[int, int], values: dict[str, str], context: str | None, anchorless: bool) -> None:
        show = values.get
        self.found.append(
            Finding(group.id, group.kind, self.s.settings.tier(group), group.category, *span, template.render(group.message, show) if group.message is not None else DEFAULT_MESSAGES[group.kind], template.render(group.advice, show) if group.advice is not None else None, None, group.url, context, anchorless)
        )

    def literal(self) -> None:
        for group, entry, needles in self.s.literals:
            hits = {(*m.span(), term) for pattern, term in zip(needles, entry.terms, strict=True) for m in pattern.finditer(self.regions.masked)}
            seen = set()
            for start, end, term in sorted(hits):
                if (start, end) not in seen:
                    seen.add((start, end))
                    self.entry(group, entry, start, end, {"match": term})

    def pattern(self) -> None:
        runs = self.regions.runs()
        for regex, owners in self.s.patterns:
            hits = {(at + m.start(), at + m.end()): m for at, run in runs for m in regex.finditer(run)}
            for (start, end), m in sorted(hits.items()):
                values = {"match": m[0]} | {k: v for k, v in m.groupdict().items() if v is not None}
                for group, entry in owners:
                    self.entry(group, entry, start, end, values)

    def vocab(self) -> None:
        text, words = self.regions.masked, tokens(self.regions.masked)
        starts = self.s.starts
        for k, (start, _, word) in enumerate(words):
            if word not in starts:
                continue
            for n in range(self.s.longest if word in self.s.heads else 1, 0, -1):
                part = words[k : k + n]
                if len(part) < n or any(text[a[1] : b[0]] != " " for a, b in zip(part, part[1:], strict=False)):
                    continue
                phrase = " ".join(w for _, _, w in part)
                if phrase in self.s.vocabulary:
                    for group, entry in self.s.vocabulary[phrase]:
                        self.entry(group, entry, start, part[-1][1], {"match": phrase})
                    break

    def metric(self) -> None:
        stats = stat_functions.compute(self.regions) if self.s.metrics else None
        for g in self.s.metrics:
            m = g.metric
            values = {"per_words": str(max(m.per_words, 1)), "stat": m.stat, "window": m.window}
            if m.stat == "term_cluster_max":
                for (start, end), terms in clusters(self.norm.text, self.s.surfaces[g.id], dict(zip(m.terms, m.lemmas, strict=True)), m.window):
                    if m.fires(len(terms)):
                        part = self.norm.text[start:end]
                        span = self.norm.span(start + len(part) - len(part.lstrip("\n")), start + len(part.rstrip("\n")))
                        self.group(g, span, values | {"value": f"{len(terms):.1f}"}, "\n  ".join(["Clustered terms:", *terms]), True)
                continue
            value = stats.get(m.stat)
            if value is not None and m.fires(value := stat_functions.steady(value)):
                span = stat_functions.anchor(m.stat, self.norm.text, self.regions)
                self.group(g, self.norm.span(*span) if span != (0, 0) else span, values | {"value": f"{value:.1f}"}, None, False)

    def repetition(self) -> None:
        prose = self.regions.prose() if self.s.repetitions else ""
        for g in self.s.repetitions:
            r = g.repetition
            if r.variant == "propositional" and self.s.embedder is None:
                self.warnings.append(f"{g.id}: propositional repetition skipped - no embedder is given")
                continue
            try:
                groups = repeated(prose, r, self.s.embedder)
            except Exception as e:
                if r.variant != "propositional":
                    raise
                self.warnings.append(f"{g.id}: embedding failed: {e}")
                continue
            for spans in groups:
                lines = []
                for s, e in spans:
                    shown = " ".join(prose[s:e].split())
                    lines.append(f"  line {line_col(self.source, self.norm.span(s, s)[0])[0]}: {shown[:EXCERPT]}{'…' if len(shown) > EXCERPT else ''}")
                self.group(g, self.norm.span(*spans[0]), {"count": str(len(spans)), "variant": r.variant}, "\n".join(["Repetition members:", *lines]), True)

    def plugin(self) -> None:
        for plugin, config in self.s.plugins:
            settings, group = self.s.settings, Group(plugin.id, "plugin", plugin.tier, plugin.category)
            if not settings.live(group):
                continue
            try:
                found = plugin.call(Envelope(self.norm.text, self.regions.ranges("heading"), self.regions.bold(), self.regions.ranges("list-item"), config))
            except PluginError as e:
                self.warnings.append(str(e))
                continue
            seen = set()
            for slug, start, end, message, advice in found:
                entry = f"{plugin.id}#{slug}"
                if slug in seen or settings.level(plugin.id, entry) == "allow":
                    continue
                seen.add(slug)
                if not 0 <= start <= end <= len(self.norm.text):
                    self.warnings.append(f"{entry}: span {start}..{end} is outside the text")
                    continue
                self.found.append(Finding(entry, "plugin", settings.tier(group, entry), plugin.category, *self.norm.span(start, end), message or DEFAULT_MESSAGES["plugin"], advice))


def clusters(text: str, surface: re.Pattern, lemmas: dict[str, int], window: str) -> list[tuple[tuple[int, int], list[str]]]:
    """(window, first surface form of each distinct lemma in order) of windows with terms."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if window == "document":
        bounds = [0, len(text)]
    elif window == "paragraph":
        bounds = [0, *(m.start() + 1 for m in re.finditer("\n(?=\n)", text)), len(text)]
    else:
        bounds = [0, *(s for s, _ in sentences(text)[1:]), len(text)]
    out, k = [], 0
    for start, end in zip(bounds, bounds[1:], strict=False):
        terms: dict[int, str] = {}
        for m in surface.finditer(low, start, end):
            terms.setdefault(lemmas[m[0]], m[0])
        if terms:
            out.append(((start, end), list(terms.values())))
        k += 1
    if out:  # the last window with terms reaches the end of the text
        out[-1] = ((out[-1][0][0], len(text)), out[-1][1])
    return out


def near_verbatim(prose: str, units: list[tuple[int, int]], threshold: float, max_distance: int) -> list[tuple[int, int]]:
    """Pairs of units within a distance that share shingles, or words in order."""
    at = token_positions(prose)
    words = [lower_runs(prose[s:e]) for s, e in units]
    sets = [shingles(prose[s:e]) for s, e in units]
    bags = [frozenset(w) for w in words]
    out = []
    for i in range(len(units)):
        for j in range(i + 1, len(units)):
            if tokens_between(at, units[i][0], units[j][0]) > max_distance:
                break
            if jaccard(sets[i], sets[j]) >= threshold:
                out.append((i, j))
                continue
            # a common subsequence has no more words than the smaller count of each
            least = min(len(words[i]), len(words[j]))
            if len(bags[i] & bags[j]) + least - min(len(bags[i]), len(bags[j])) >= LCS_BAR * least and lcs_ratio(words[i], words[j]) >= LCS_BAR:
                out.append((i, j))
    return out


def propositional(prose: str, units: list[tuple[int, int]], threshold: float, max_distance: int, embedder: Embedder) -> list[tuple[int, int]]:
    """Pairs of units within a distance whose unit vectors' dot product reaches the threshold."""
    import numpy as np

    if len(units) < 2:
        return []
    v = np.asarray(embedder([prose[s:e] for s, e in units]), np.float32)
    if len(v) != len(units):
        raise ValueError(f"{len(v)} vectors for {len(units)} units")
    at = np.searchsorted(token_positions(prose), [s for s, _ in units])
    ends = np.searchsorted(at, at + max_distance, "right")  # of the units within the distance
    out = []
    for k in range(0, len(units), 256):  # no more products at once than the distance allows
        to = min(k + 256, len(units))
        close = (v[k:to] @ v[k : ends[to - 1]].T).astype(np.float64) >= threshold
        out += [(k + i, k + j) for i, j in zip(*(x.tolist() for x in np.nonzero(close)), strict=True) if i < j and k + j < ends[k + i]]
    return out


def content_family(prose: str, units: list[tuple[int, int]], threshold: float) -> list[tuple[int, int]]:
    """Pairs of paragraphs that share content words; of eight paragraphs or more, words in over half of them don't count."""
    sets = [set(content_words(prose[s:e])) for s, e in units]
    if len(sets) >= 8:
        counts: dict[str, int] = {}
        for s in sets:
            for w in s:
                counts[w] = counts.get(w, 0) + 1
        sets = [{w for w in s if counts[w] <= len(sets) // 2} for s in sets]
    # of paragraphs that have words in common, how many: by each word's earlier paragraphs
    places: dict[str, list[int]] = {}
    out = []
    for j, words in enumerate(sets):
        if len(words) < 6:
            continue
        shared: dict[int, int] = {}
        for w in words:
            for i in places.setdefault(w, []):
                shared[i] = shared.get(i, 0) + 1
            places[w].append(j)
        out += [(i, j) for i, n in shared.items() if n >= 2 and n / min(len(sets[i]), len(words)) >= threshold]
    return sorted(out)


def repeated(prose: str, rule: Repetition, embedder: Embedder | None = None) -> list[list[tuple[int, int]]]:
    """Groups of repeated units, each in order."""
    if rule.variant == "content-family":
        units = paragraphs(prose)
        pairs = content_family(prose, units, rule.threshold)
    else:
        units = sentence_units(prose, UNIT_WORDS[rule.variant])
        pairs = near_verbatim(prose, units, rule.threshold, rule.max_distance) if rule.variant == "near-verbatim" else propositional(prose, units, rule.threshold, rule.max_distance, embedder)
    groups = [[units[i] for i in g] for g in components(len(units), pairs) if len(g) >= rule.min_members]
    if rule.variant == "propositional" and groups:
        verbatim_units = sentence_units(prose, UNIT_WORDS["near-verbatim"])
        verbatim = [{verbatim_units[i] for i in g} for g in components(len(verbatim_units), near_verbatim(prose, verbatim_units, VERBATIM_BAR, rule.max_distance))]
        groups = [g for g in groups if not any(set(g) <= v for v in verbatim)]
    return groups


__all__ = ["Embedder", "Finding", "Normalized", "Scanner", "clusters", "repeated"]

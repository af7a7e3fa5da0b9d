"""Rules prove themselves: every entry must hit its group's must_match and miss its must_not_match samples."""

from __future__ import annotations

import re

from . import literals, policy
from .model import Entry, Group


def hits(group: Group, entry: Entry, sample: str) -> bool:
    """Whether an entry matches a sample, as plain text without markdown."""
    if group.kind == "pattern":
        return policy.compiled(entry.regex).search(sample) is not None
    if group.kind == "literal-ban":
        return any(literals.compiled(t).search(sample) for t in entry.terms)
    low = sample.lower()
    if not entry.word_boundary:
        return any(t in low for t in entry.terms)
    return any(re.search(rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])", low) for t in entry.terms)


def failures(group: Group, must_match: list[str], must_not_match: list[str]) -> list[str]:
    out = []
    for entry in group.entries:
        out += [f"{entry.id}: must_match sample isn't matched: {s!r}" for s in must_match if not hits(group, entry, s)]
        out += [f"{entry.id}: must_not_match sample is matched: {s!r}" for s in must_not_match if hits(group, entry, s)]
    return out

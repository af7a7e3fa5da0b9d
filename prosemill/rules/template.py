"""Message templates: {name} and {name:.1%}, with {{ and }} for braces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

SPECS = (".0", ".1", ".2", ".0%", ".1%", ".2%")
_PIECE = re.compile(r"\{\{|\}\}|\{([A-Za-z0-9_]+)(?::([^}]*))?\}")


def placeholders(template: str) -> list[tuple[str, str | None]]:
    return [(m[1], m[2]) for m in _PIECE.finditer(template) if m[1]]


def problems(template: str, allowed: Iterable[str]) -> list[str]:
    """What is wrong with a template whose placeholders must be among allowed."""
    allowed, found = list(allowed), placeholders(template)
    unknown = [f"{{{name}}}" for name, _ in found if name not in allowed]
    if unknown:
        shown = ", ".join(f"{{{a}}}" for a in allowed)
        return [f"unknown placeholder(s) {', '.join(unknown)} - allowed: {shown}"]
    return [f"placeholder {{{name}}}: unknown format spec `:{spec}` (allowed: {' '.join(SPECS)})" for name, spec in found if spec is not None and spec not in SPECS]


def formatted(value: str, spec: str | None) -> str:
    if spec not in SPECS:
        return value
    try:
        number = float(value)
    except ValueError:
        return value
    # a percentage shows one place less per character than its spec says: none for `.0%` to `.2%`
    return f"{number * 100:.0f}%" if spec.endswith("%") else f"{number:.{spec[1]}f}"


def render(template: str, value: Callable[[str], str | None]) -> str:
    def piece(m: re.Match) -> str:
        if m[1] is None:
            return m[0][0]
        found = value(m[1])
        return f"{{{m[1]}}}" if found is None else formatted(found, m[2])

    return _PIECE.sub(piece, template)

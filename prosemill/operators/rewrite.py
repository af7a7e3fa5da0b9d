"""Mechanical fixes: replacements of vocabulary findings that no other finding overlaps."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.eol import byte_offsets
from .scan import Finding


@dataclass
class Fixed:
    text: str
    applied: int
    overlapped: int
    unfixable: int


def fix(source: str, findings: list[Finding]) -> Fixed:
    """The text with all safe replacements; an empty one also takes a following space. unfixable: findings of tiers 1
    and 2 without a replacement."""
    spanned = [f for f in findings if (f.start, f.end) != (0, 0)]
    safe, overlapped, unfixable = [], 0, 0
    for f in findings:
        if f.kind != "vocab" or f.replacement is None:
            unfixable += f.tier < 3
        elif any(o is not f and o.start < f.end and f.start < o.end for o in spanned):
            overlapped += 1
        else:
            safe.append(f)
    text = source
    if safe:
        places = list(range(len(source) + 1))
        at = {b: p for p, b in byte_offsets(source, places).items()}
        for f in sorted(safe, key=lambda f: -f.start):
            start, end = at[f.start], at[f.end]
            end += f.replacement == "" and text[end : end + 1] == " "
            text = text[:start] + f.replacement + text[end:]
    return Fixed(text, len(safe), overlapped, unfixable)

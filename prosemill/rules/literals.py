"""Literal needles: {N} stands for a run of ASCII digits, {{ and }} for braces."""

from __future__ import annotations

import re

_PIECE = re.compile(r"\{\{|\}\}|\{N\}|[{}]|[^{}]+")


def compiled(term: str) -> re.Pattern:
    """The needle as a case-insensitive pattern; its digit runs never give digits back."""
    out = []
    for piece in _PIECE.findall(term):
        if piece == "{N}":
            out.append("[0-9]++")
        elif piece == "{":
            raise ValueError(f"single `{{` in literal {term!r}; write {{{{ or {{N}}")
        else:
            out.append(re.escape(piece[0] if piece in ("{{", "}}") else piece))
    if not out:
        raise ValueError("empty literal")
    return re.compile("".join(out), re.IGNORECASE)

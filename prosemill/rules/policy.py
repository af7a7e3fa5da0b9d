"""The regex policy: only constructs that a linear-time engine has, with bounded repetition of wide classes."""

from __future__ import annotations

import re

_BANNED = {
    "(?R)": "recursion (?R) is not allowed",
    "(?&": "recursion (?R) is not allowed",
    "(?>": "atomic groups are not supported (backtracking only)",
    "(?=": "lookahead is not supported; widen the match and use a named capture",
    "(?!": "lookahead is not supported; widen the match and use a named capture",
    "(?<=": "lookbehind is not supported; match the context and capture the tail",
    "(?<!": "lookbehind is not supported; match the context and capture the tail",
}
_ITEM = re.compile(r"\\(?P<escape>.)|(?P<group>\(\?(?:R\)|&|>|=|!|<=|<!))|(?P<set>\[\^?(?:\\.|[^\]\\])*\])|(?P<many>[*+])|(?P<other>.)", re.S)


def violation(pattern: str) -> str | None:
    """Why a pattern is refused, or None. `*` and `+` may follow one character that isn't a dot, or a class that holds
    an escape or a letter w, s or d; a repetition of a group must be bounded."""
    before = None
    for m in _ITEM.finditer(pattern):
        kind, text = m.lastgroup, m[0]
        if kind == "escape" and m["escape"] in "123456789":
            return f"backreference \\{m['escape']} is not allowed"
        if kind == "group":
            return f"{_BANNED[text]} (at {m.start()})"
        if kind == "many":
            kind_before, shown = before or (None, "")
            fine = kind_before in ("escape", "other") and shown not in (".", ")", "(", "|", "\n")
            fine = fine or kind_before == "set" and any(c in shown for c in "\\wsd")
            if not fine:
                return f"unbounded `{text}` at {m.start()}; use {{m,n}} bounds"
        before = (kind, text)
    return None


def compiled(source: str) -> re.Pattern:
    """A policy-checked, case-insensitive pattern."""
    why = violation(source.strip())
    if why:
        raise ValueError(why)
    return re.compile(source.strip(), re.IGNORECASE)

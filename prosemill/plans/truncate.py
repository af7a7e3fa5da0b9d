"""Source lines cut to a width of terminal cells around a span."""

from __future__ import annotations

import unicodedata

TAB, PADDING, LEAST = 4, 4, 10


def clusters(line: str) -> list[str]:
    """Characters with the marks, joiners and modifiers that are shown in one place with them."""
    out: list[str] = []
    for c in line:
        joined = out and (unicodedata.combining(c) or c in "‍︎️" or out[-1].endswith("‍") or 0x1F3FB <= ord(c) <= 0x1F3FF)
        if joined:
            out[-1] += c
        else:
            out.append(c)
    return out


def cells(cluster: str) -> int:
    if cluster == "\t":
        return TAB
    if unicodedata.category(cluster[0]) in ("Cc", "Cf", "Mn"):
        return 0
    return 2 if "️" in cluster or unicodedata.east_asian_width(cluster[0]) in "WF" else 1


def window(line: str, start: int, end: int, width: int) -> tuple[str, int, int]:
    """(shown, cells before the span, cells of the span): of a line the clusters around a span of characters that fit a
    width, with an ellipsis where it is cut. A width of 0 fits all; the span itself is cut at its end only."""
    parts, at, first, last = clusters(line), 0, None, 0
    sizes = [cells(p) for p in parts]
    for k, p in enumerate(parts):
        if at < end and at + len(p) > start or at <= start < at + len(p):
            first, last = k if first is None else first, k + 1
        at += len(p)
    if first is None:
        first = last = len(parts)
    lo, hi = 0, len(parts)
    if width and sum(sizes) > width:
        budget = max(width - PADDING, LEAST) - 2
        lo = first
        hi, used = lo, 0
        while hi < len(parts) and used + sizes[hi] <= budget and (hi < last or used < sum(sizes[first:last])):
            used += sizes[hi]
            hi += 1
        while used < budget and (lo > 0 or hi < len(parts)):
            before = used
            if lo > 0 and used + sizes[lo - 1] <= budget:
                lo -= 1
                used += sizes[lo]
            if hi < len(parts) and used + sizes[hi] <= budget:
                used += sizes[hi]
                hi += 1
            if used == before:
                break
    shown = ("…" if lo else "") + "".join(parts[lo:hi]).replace("\t", " " * TAB) + ("…" if hi < len(parts) else "")
    return shown, bool(lo) + sum(sizes[lo:first]), max(1, sum(sizes[first : min(last, hi)]))

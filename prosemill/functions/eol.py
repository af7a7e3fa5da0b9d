"""Line ends: text normalised to \\n, and spans mapped back to the original."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np


@dataclass
class Normalized:
    """text: with \\n only; pairs: places in it of each \\n that was \\r\\n; size: length of the original."""

    text: str
    pairs: list[int]
    size: int

    def span(self, start: int, end: int) -> tuple[int, int]:
        """A span of text in the original; one that ends before a former pair ends before its \\r."""
        first = start + bisect_right(self.pairs, start)
        last = self.size if end >= len(self.text) else end + bisect_left(self.pairs, end)
        return first, max(last, first if start == end else 0)


def normalize(source: str) -> Normalized:
    if "\r" not in source:
        return Normalized(source, [], len(source))
    pairs = [m.start() - k for k, m in enumerate(re.finditer(r"\r\n", source))]
    return Normalized(re.sub(r"\r\n?", "\n", source), pairs, len(source))


def byte_offsets(text: str, places: list[int]) -> dict[int, int]:
    """UTF-8 offsets of places in a text."""
    if text.isascii():
        return {p: p for p in places}
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return {p: int(ends[p]) for p in places}


def line_col(text: str, place: int) -> tuple[int, int]:
    """1-based line and column, in characters."""
    before = text.rfind("\n", 0, place)
    return text.count("\n", 0, place) + 1, place - before

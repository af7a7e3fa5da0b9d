"""Document statistics and the places where they first show."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .markdown import Regions
from .words import sentences, word_count

#: Patterns and words that the statistics count by.
_TRICOLON = re.compile(r"\b[a-z]+, [a-z]+, and [a-z]+\b", re.ASCII)
_EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿]")
_MINOR = frozenset("of the and in on to an a for".split())
#: Words, sentences and list items below which a statistic says nothing.
LEAST_WORDS, LEAST_SENTENCES, LEAST_ITEMS, LEAST_QUOTES = 250, 6, 4, 20


@dataclass
class DocStats:
    word_count: int
    sentence_count: int
    bullet_count: int
    values: dict[str, float]

    def get(self, stat: str) -> float | None:
        """A statistic, or None below its floor."""
        if stat == "emoji_decoration_count":
            return self.values[stat]
        if stat == "sent_len_cv":
            return self.values[stat] if self.sentence_count >= LEAST_SENTENCES else None
        if stat == "bullet_boldlead_fraction":
            return self.values[stat] if self.bullet_count >= LEAST_ITEMS else None
        return self.values[stat] if self.word_count >= LEAST_WORDS else None


def is_titlecase(heading: str) -> bool:
    words = [w for w in heading.split() if any(c.isalnum() for c in w)]
    rest = [w for w in words[1:] if w.lower() not in _MINOR]
    return len(words) >= 3 and bool(rest) and 100 * sum(next((c for c in w if c.isalnum()), "").isupper() for w in rest) >= 80 * len(rest)


def longest_run(flags: list[bool]) -> int:
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


def opener_run(texts: list[str]) -> int:
    """Longest run of sentences with the same first two words; one with under two words ends a run."""
    best, now, before = 0, 0, None
    for t in texts:
        words = t.lower().split()[:2]
        if len(words) < 2:
            before = None
            continue
        now = now + 1 if words == before else 1
        before, best = words, max(best, now)
    return best


def variation(counts: list[int]) -> float:
    """Population standard deviation over mean; 0 for fewer than six values."""
    mean = sum(counts) / len(counts) if counts else 0
    if len(counts) < LEAST_SENTENCES or not mean:
        return 0.0
    return (sum((c - mean) ** 2 for c in counts) / len(counts)) ** 0.5 / mean


def steady(value: float) -> float:
    """A statistic to six places, halves up: the last bits of a sum decide neither a threshold nor a digit that is shown."""
    return math.floor(value * 1e6 + 0.5) / 1e6


def compute(regions: Regions) -> DocStats:
    prose, bold = regions.prose(), regions.bold()
    headings, items = regions.ranges("heading"), regions.ranges("list-item")
    words, units = word_count(prose), [prose[s:e] for s, e in sentences(prose)]
    curly, straight = prose.count("“") + prose.count("”"), prose.count('"')
    led = sum(any(s - 1 <= b <= s + 3 for b, _ in bold) for s, _ in items)
    values = {
        "em_dash_rate": prose.count("—") * 1000 / max(words, 1),
        "curly_double_ratio": curly / (curly + straight) if curly + straight >= LEAST_QUOTES else 0.0,
        "bold_density": len(bold) * 100 / max(words, 1),
        "heading_titlecase_fraction": sum(is_titlecase(prose[s:e]) for s, e in headings) / len(headings) if headings else 0.0,
        "emoji_decoration_count": float(sum(len(_EMOJI.findall(prose[s:e])) for s, e in headings + items)),
        "bullet_boldlead_fraction": led / len(items) if len(items) >= LEAST_ITEMS else 0.0,
        "tricolon_max_streak": float(longest_run([_TRICOLON.search(u) is not None for u in units])),
        "sent_len_cv": variation([word_count(u) for u in units]),
        "opening_ngram_repeat": float(opener_run(units)),
    }
    return DocStats(words, len(units), len(items), values)


def anchor(stat: str, text: str, regions: Regions) -> tuple[int, int]:
    """Where a statistic first shows; (0, 0) for those of a whole document."""
    headings, items, bold = regions.ranges("heading"), regions.ranges("list-item"), regions.bold()
    found = None
    if stat == "curly_double_ratio":
        found = re.search("[“”]", text)
    elif stat == "em_dash_rate":
        found = re.search("—", text)
    elif stat == "tricolon_max_streak":
        found = _TRICOLON.search(text)
    if found:
        return found.span()
    if stat == "bold_density":
        return bold[0] if bold else (0, 0)
    if stat == "heading_titlecase_fraction":
        return next(((s, e) for s, e in headings if is_titlecase(text[s:e])), headings[0] if headings else (0, 0))
    if stat == "emoji_decoration_count":
        return next(((s + m.start(), s + m.end()) for s, e in headings + items for m in _EMOJI.finditer(text[s:e])), (0, 0))
    if stat == "bullet_boldlead_fraction":
        return next(((s, e) for s, e in items if any(b <= s + 3 for b, _ in bold)), (0, 0))
    return 0, 0

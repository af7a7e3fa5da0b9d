"""Words, sentences, paragraphs, shingles and similarities of one text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

_UAX_WORD = re.compile(r"\w+(?:(?:(?<=[^\W\d_])['’.:·](?=[^\W\d_])|(?<=\d)[.,;'’](?=\d))\w+)*")
_RUN = re.compile(r"[^\W_]+")
_ALNUM = re.compile(r"[^\W_]")
_WORD_OF_ANY = re.compile(r"[^\s\w]*_*[^\W_]\S*|\S*[^\W_]\S*")
#: Abbreviations after which no sentence ends.
GUARDS = ("e.g", "i.e", "dr", "vs", "etc", "mr")
#: Words without content of their own.
STOPWORDS = frozenset(
    "the a an and or but if of to in on at for with is are was were be been being it its this that these those they them their we our us you your i my me he she his her as by from has have had do does did not no so than then there what which who will would can could should just about into over after before".split()
)
_TERMINAL = re.compile(r"[.!?。！？]")
_CLOSE = "\"')]}»”’"
_SPACE = " \t\xa0"


def each_token(masked: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-case word) by Unicode's word rules, of words with a letter or digit; hyphens part words."""
    found = ((m.start(), m.end(), m[0].lower()) for m in _UAX_WORD.finditer(masked))
    return (t for t in found if _ALNUM.search(t[2])) if "_" in masked else found


def tokens(masked: str) -> list[tuple[int, int, str]]:
    return list(each_token(masked))


def word_count(text: str) -> int:
    """White-space-separated words with a letter or digit."""
    return len(_WORD_OF_ANY.findall(text))


def lower_runs(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def each_position(text: str) -> Iterator[int]:
    return (m.start() for m in re.finditer(r"\S+", text))


def token_positions(text: str) -> list[int]:
    return list(each_position(text))


def first_words(text: str, n: int) -> str:
    """The first n white-space words of a window, one space between them."""
    return " ".join(text.split(None, n)[:n])


def _breaks(text: str) -> list[int]:
    """Places where sentences end by Unicode's sentence rules, for text whose line ends part paragraphs."""
    out, n, at = [], len(text), 0
    newline = re.compile("[.!?。！？\n]")
    while m := newline.search(text, at):
        k = m.start()
        if text[k] == "\n":
            out.append(k + 1)
            at = k + 1
            continue
        j = k + 1
        while j < n and text[j] in ".!?。！？":
            j += 1
        last = text[j - 1]
        run = j
        while j < n and text[j] in _CLOSE:
            j += 1
        while j < n and text[j] in _SPACE:
            j += 1
        at = max(j, k + 1)
        if j >= n:
            out.append(n)
            continue
        following = text[j]
        if following == "\n":
            continue  # the line end itself breaks
        if last == "." and run == j:
            if following.isdigit() or text[k - 1 : k].isalpha() and following.isupper():
                continue
        if following in ",-:;、":
            continue
        if last == ".":
            ahead = re.compile(r"[^\W\d_]|[\n.!?。！？]").search(text, j)
            if ahead and ahead[0].islower():
                continue
        out.append(j)
    return out


def sentences(prose: str) -> list[tuple[int, int]]:
    """Spans of sentences with at least a word, trimmed at the right; single line ends join lines, empty lines part."""
    joined = re.sub(r"(?<!\n)\n(?!\n)", " ", prose)
    cuts = sorted({0, *_breaks(joined), len(joined)})
    spans = []
    for s, e in zip(cuts, cuts[1:], strict=False):
        e = s + len(joined[s:e].rstrip())
        if e > s and word_count(joined[s:e]):
            spans.append((s, e))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and _guarded(joined[out[-1][0] : out[-1][1]]):
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _guarded(sentence: str) -> bool:
    last = sentence.rstrip(".").rsplit(None, 1)[-1:] if sentence.endswith(".") else []
    return bool(last) and last[0].lstrip("(\"'“‘").lower() in GUARDS


def paragraphs(prose: str) -> list[tuple[int, int]]:
    """Trimmed spans with a word between empty lines."""
    out, at = [], 0
    for m in [*re.finditer("(?<=\n)(?=\n)", prose), None]:
        end = m.start() if m else len(prose)
        part = prose[at:end]
        if word_count(part):
            out.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
        at = end
    return out


def sentence_units(prose: str, least: int) -> list[tuple[int, int]]:
    """Sentences of at least so many words that aren't cues in brackets."""
    return [(s, e) for s, e in sentences(prose) if word_count(prose[s:e]) >= least and not (prose[s] == "[" and prose[e - 1] == "]")]


def shingles(text: str) -> frozenset[tuple[str, ...]]:
    """Runs of 8 words, or of 4 for texts of under 8; none under 4."""
    w = lower_runs(text)
    k = 8 if len(w) >= 8 else 4
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def content_words(text: str) -> list[str]:
    return sorted({w for w in lower_runs(text) if len(w.encode()) >= 3 and w not in STOPWORDS})


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence of two word lists, on the bits of one integer."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: list[str], b: list[str]) -> float:
    return lcs_length(a, b) / min(len(a), len(b)) if a and b else 0.0


def tokens_between(positions: Sequence[int], a: int, b: int) -> int:
    """White-space words that begin in [a, b)."""
    from bisect import bisect_left

    return bisect_left(positions, b) - bisect_left(positions, a)


def components(n: int, pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Groups of at least two of 0..n-1 that pairs connect, ascending."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for x in range(n):
        groups.setdefault(root(x), []).append(x)
    return [g for g in groups.values() if len(g) > 1]

"""A masking markdown scanner: code, link targets and URLs become NULs, in a text of the same length.

Blocks: fenced and indented code, HTML, ATX and setext headings, nested list items, tables, link reference and footnote
definitions. Spans: code between equal runs of backticks, inline links' targets, autolinks, bare URLs. Lines end at \\n.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

MASK = "\0"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)")
_ATX = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
_ITEM = re.compile(r"( *)([-+*]|\d{1,9}[.)])(?=[ \t]|$)[ \t]*")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_CELL = re.compile(r"(?:[^|\\]|\\.)+")
_REFERENCE = re.compile(r" {0,3}\[(?!\^)[^\]\n]+\]:[ \t]*(<[^>\n]*>|\S+)")
_TICKS = re.compile(r"`+")
_TARGET = re.compile(r"\]\([ \t]*(<[^>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))+)")
_AUTO = re.compile(r"<(?:[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+)>")
#: HTML blocks: how they begin, what ends them (an empty line if nothing does), and if they can end a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[ \t>]|/>|$)", re.I), None, True),
    (re.compile(r"(?:<[a-zA-Z][a-zA-Z0-9-]*(?:[ \t]+[a-zA-Z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*[ \t]*/?>|</[a-zA-Z][a-zA-Z0-9-]*[ \t]*>)[ \t]*$"), None, False),
]
#: What any block or span that matters begins with; a text without it is prose throughout.
_MARKS = re.compile(r"[`<\[]|~~~|https?://|^(?: {0,3}(?:#|[-+*=]|\d{1,9}[.)])| {4}| *\t)", re.M)
_INLINE = re.compile(r"`|\]\(|<")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_URL = re.compile(r"https?://[^\s)\]]*")
_BOLD = re.compile(r"\*\*(.*?)\*\*", re.S)
_QUOTES = (('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"), ("«", "»"))


@dataclass
class Regions:
    """masked: the text with hidden characters as NUL; scopes: (start, end, 'heading' or 'list-item', level), sorted."""

    masked: str
    scopes: list[tuple[int, int, str, int]] = field(default_factory=list)

    def scope_at(self, place: int) -> str:
        k = bisect_right(self.scopes, (place, 1 << 62, "", 0)) - 1
        while k >= 0:
            start, end, kind, _ = self.scopes[k]
            if start <= place < end:
                return kind
            k -= 1
        return "prose"

    def ranges(self, kind: str) -> list[tuple[int, int]]:
        return [(s, e) for s, e, what, _ in self.scopes if what == kind]

    def bold(self) -> list[tuple[int, int]]:
        """(place of the opening stars, place of the closing ones)."""
        return [(m.start(), m.end(1)) for m in _BOLD.finditer(self.masked)]

    def prose(self) -> str:
        return self.masked.replace(MASK, " ")

    def runs(self) -> list[tuple[int, str]]:
        """Maximal visible stretches with their places."""
        return [(m.start(), m[0]) for m in re.finditer(r"[^\0]+", self.masked)]


def _hidden(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with NULs in the spans, line ends kept."""
    out, at = [], 0
    for start, end in sorted(spans):
        start, end = max(start, at), min(end, len(text))
        if start < end:
            part = text[start:end]
            out += [text[at:start], re.sub(r"[^\n]", MASK, part) if "\n" in part else MASK * len(part)]
            at = end
    return "".join([*out, text[at:]]) if out else text


def _html(rest: str, in_paragraph: bool) -> tuple[bool, re.Pattern | None]:
    """If an HTML block begins with a line, and what ends it."""
    shown = rest.lstrip(" ")
    if shown.startswith("<"):
        for begins, ends, interrupts in _HTML:
            if (interrupts or not in_paragraph) and begins.match(shown):
                return True, ends
    return False, None


def _cells(line: str, at: int) -> list[tuple[int, int]]:
    return [(at + m.start(), at + m.end()) for m in _CELL.finditer(line) if m[0].strip()]


def build_regions(text: str, empty_code: bool = False) -> Regions:
    """What is hidden in a text, and its scopes. empty_code: two backticks that nothing closes are code with nothing in it,
    of which the second is hidden; in markdown they are text."""
    if not _MARKS.search(text):
        return Regions(text)
    hidden: list[tuple[int, int]] = []
    scopes: list[tuple[int, int, str, int]] = []
    items: list[tuple[int, int, int, int]] = []  # (start, content indent, marker indent, level)
    fence, fence_at, place, blank, paragraph = None, 0, 0, True, None
    html, html_end, table, before = False, None, False, 0
    inline: list[tuple[int, int]] = []  # stretches of text that may hold spans

    def close_items(indent: int, end: int) -> None:
        while items and indent < items[-1][1]:
            start, _, _, level = items.pop()
            scopes.append((start, end, "list-item", level))

    for line in _LINE.findall(text):
        start, place = place, place + len(line)
        body, last, before = line.rstrip("\n"), before, start
        indent = len(body) - len(body.lstrip(" "))
        if fence is not None:
            m = _FENCE.match(body.lstrip(" ") if items else body)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                hidden.append((fence_at, place))
                fence = None
            continue
        if html:
            html = not html_end.search(body) if html_end else bool(body.strip())
            if html or html_end:
                continue
        if not body.strip():
            blank, paragraph, table = True, None, False
            continue
        marker = _ITEM.match(body)
        if items and indent < items[-1][1] and (blank or marker):
            close_items(indent, start)
        inside = items[-1][1] if items else 0
        rest = body[min(inside, indent) :]
        at = start + min(inside, indent)
        m = _FENCE.match(rest)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, fence_at, blank, paragraph, table = m[1], at + len(rest) - len(rest.lstrip(" ")), False, None, False
            continue
        if indent - inside >= 4 and (blank or paragraph is None) and not (marker and items):
            if paragraph is None:
                hidden.append((start, place))
                blank = False
                continue
        if indent - inside < 4:
            html, html_end = _html(rest, paragraph is not None)
            if html:
                html = not (html_end and html_end.search(rest))
                blank, paragraph, table = False, None, False
                continue
        if _RULE.match(rest) and not (paragraph is not None and _SETEXT.match(rest)):
            blank, paragraph, table = False, None, False
            continue
        if marker and indent - inside < 4 and not _RULE.match(rest):
            close_items(indent, start) if items and indent < items[-1][1] else None
            width = marker.end() if marker.end() > len(marker[1]) + len(marker[2]) and marker.end() < len(body) else len(marker[1]) + len(marker[2]) + 1
            items.append((start + indent, width, indent, len(items) + 1))
            inline.append((start + marker.end(), place))
            blank, paragraph, table = False, start, False
            continue
        atx = _ATX.match(rest)
        if atx:
            scopes.append((at + atx.start(1), start + len(body), "heading", len(atx[1])))
            inline.append((at, place))
            blank, paragraph, table = False, None, False
            continue
        if table:
            inline += _cells(rest, at)
            continue
        if paragraph is not None and paragraph == last and "|" in rest + text[last:start] and _ROW.match(rest):
            header = _cells(text[last:start].rstrip("\n"), last)
            if len(header) == len(_cells(rest, at)):
                inline[-1:] = header
                table = True
                continue
        if paragraph is not None and not items and _SETEXT.match(rest):
            scopes.append((paragraph, start + len(body), "heading", 1 if "=" in rest else 2))
            blank, paragraph = False, None
            continue
        reference = _REFERENCE.match(rest) if paragraph is None else None
        if reference:
            hidden.append((at + reference.start(1), at + reference.end(1)))
            blank = False
            continue
        note = _FOOTNOTE.match(rest)
        if note:
            inline.append((at + note.end(), place))
            blank, paragraph = False, start
            continue
        if inline and paragraph is not None and inline[-1][1] == start:
            inline[-1] = (inline[-1][0], place)
        else:
            inline.append((start, place))
        paragraph = start if paragraph is None else paragraph
        blank = False
    if fence is not None:
        hidden.append((fence_at, len(text)))
    close_items(-1, len(text))
    if _INLINE.search(text):
        for s, e in inline:
            _spans(hidden, text, s, e, empty_code)
    masked = _hidden(text, hidden)
    if "http" in masked:
        masked = _hidden(masked, [m.span() for m in _URL.finditer(masked)])
    return Regions(masked, sorted(scopes))


def _spans(hidden: list[tuple[int, int]], text: str, start: int, end: int, empty_code: bool) -> None:
    """Code spans, then targets and autolinks in what is left of text[start:end]."""
    code: list[tuple[int, int]] = []
    ticks = list(_TICKS.finditer(text, start, end))
    k = 0
    while k < len(ticks):
        close = next((j for j in range(k + 1, len(ticks)) if len(ticks[j][0]) == len(ticks[k][0])), None)
        if close is None:
            if empty_code and len(ticks[k][0]) == 2:
                code.append((ticks[k].end() - 1 - start, ticks[k].end() - start))
            k += 1
            continue
        code.append((ticks[k].end() - start, ticks[close].end() - start))
        k = close + 1
    left = _hidden(text[start:end], code)
    hidden += [(start + s, start + e) for s, e in code]
    hidden += [(start + m.start(1), start + m.end(1)) for m in _TARGET.finditer(left)]
    hidden += [(start + m.start(), start + m.end()) for m in _AUTO.finditer(left)]


def mask_quoted(regions: Regions, dictionary: frozenset[str] | set[str]) -> Regions:
    """Hides quoted mentions of dictionary terms: quotes and words, in ASCII characters only, line ends kept."""
    masked = regions.masked
    chars = None
    for opener, closer in _QUOTES:
        at = masked.find(opener)
        while at >= 0:
            close = masked.find(closer, at + 1)
            if close < 0:
                break
            if masked[at + 1 : close].strip().lower() in dictionary:
                chars = chars or list(masked)
                for k in range(at, close + 1):
                    if chars[k] != "\n" and chars[k].isascii():
                        chars[k] = MASK
            at = masked.find(opener, at + 1)
    return Regions("".join(chars), regions.scopes) if chars else regions

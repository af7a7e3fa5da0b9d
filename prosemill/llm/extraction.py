"""Main text of web pages by templates deduced from equivalence classes of tokens.

The tokens of a page are its elements, by their roles (name, class words and id, under the parent's role), and its runs
of text. A token's occurrence vector says how often it stands on each of its host's pages; it is carried as two sums
modulo a prime over hashes of the pages, which add up in any order, so that a host of any size costs one row a token
and task. Of n pages with the same elements and text each counts as an nth.

1. Classes: tokens of a host with equal vectors, on enough pages. Those that stand once on each of these are anchors.
2. Validation: a class is valid if its anchors come in one order on its pages and all lie in one gap of the host's
   first class, which the pages share: it is nested there. The rest are no anchors.
3. Template: the anchors of valid classes, nested by their roles, in order. What stands in an anchor but in no smaller
   one is its slot; slots hold what varies, runs of text that most pages share are the template's own.
4. The slots of the article: from the root down to the element whose slots share the host's text among them; of its
   parts those from the first to the last that hold text of weight or a heading that varies, without those that hold
   links or template text for the most part.

Within the article's slots, and on pages that no template is known of, markup has its say: elements that are menus,
forms, asides and the like by name, class, id or role go.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Distinct pages that a host needs for a template (two that share a run may be versions of one page); shares of its pages
#: with a role and with a run of text that make them the template's.
LEAST_PAGES, ROLE_SHARE, TEMPLATE_SHARE = 3, 0.5, 0.9
#: Share of a host's text in template runs from which on its pages are versions of one page, and no run is the template's.
VERSIONS_SHARE = 0.5
#: Share of the text around it that makes a part one of weight; share of a part's text in links, or of template text
#: against its own, from which on it is no slot of an article's.
WEIGHT, FILLED_SHARE = 0.05, 0.5
#: Sums of occurrence vectors are taken modulo this prime.
PRIME = (1 << 31) - 1
#: Largest size of all templates that is broadcast; beyond it pages and templates are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Pages with copies that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center details dd dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELL = frozenset("td th br img input".split())
#: Elements that aren't shown as text, and elements that aren't an article's.
_UNSHOWN = frozenset("head script style noscript iframe svg math template object canvas audio video title textarea datalist".split())
_NOT_TEXT = frozenset("nav footer aside form button select menu dialog label".split())
#: Words of a class, id or role that say the same.
_NOT_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer comment comments ad ads advert adverts advertisement advertising banner cookie cookies consent notice notices popup modal promo promotion sponsor sponsored share sharing social related breadcrumb breadcrumbs pagination pager widget newsletter subscribe subscription disqus respond replies complementary contentinfo search login signup masthead toolbar".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z]+")
#: Numbers of items, as in post-1234.
_DIGITS = re.compile(r"\d{3,}")
#: What an opening tag ends if it is open, up to the elements that hold it back.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_HOLDS = frozenset("table td th li ul ol div section article main body blockquote figure aside nav form header footer".split())


def hashed(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Element:
    __slots__ = ("name", "role", "role_hash", "unshown", "out", "article", "link", "heading")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        words, shown, unshown = set(), [], name in _UNSHOWN
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    unshown = True
                elif key != "itemprop":
                    words.update(w.lower() for w in _PART.findall(value))
                shown.append(f"{key}={_DIGITS.sub('0', value)}")
        inside = parent is not None and parent.article
        self.article = inside or name in ("article", "main") or "articlebody" in attributes.lower()
        out = name in _NOT_TEXT or name == "header" and not inside or bool(words & _NOT_WORDS) and name not in ("html", "body")
        self.name, self.out, self.unshown = name, out or parent is not None and parent.out, unshown or parent is not None and parent.unshown
        self.link = name == "a" or parent is not None and parent.link
        self.heading = name in _HEADINGS or parent is not None and parent.heading
        self.role = f"{parent.role if parent is not None else ''}/{name}[{' '.join(sorted(shown))}]"
        self.role_hash = hashed(self.role)


class Page:
    """roles: every element's role, its parent's and its place, in order; blocks: (elements open around it, text, characters
    of links in it, place). Places count elements and blocks together."""

    def __init__(self, source: str):
        self.roles: list[tuple[int, int, int]] = []
        self.blocks: list[tuple[tuple[Element, ...], str, int, int]] = []
        self.stack: list[Element] = []
        self.made: dict[tuple[int, str, str], Element] = {}
        self.texts: list[str] = []
        self.linked = 0
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.close(name)
                continue
            self.open(name, m[3])
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
        self.flush()

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top is None or not top.unshown:
            shown = html.unescape(raw) if "&" in raw else raw
            self.texts.append(shown)
            if top is not None and top.link:
                self.linked += len(shown)

    def flush(self) -> None:
        if self.texts:
            if shown := " ".join("".join(self.texts).split()):
                self.blocks.append((tuple(self.stack), shown, min(self.linked, len(shown)), len(self.roles) + len(self.blocks)))
            self.texts, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self.flush()
            self.end({"p"}, _HOLDS)
        elif name in _CELL:
            self.texts.append(" ")
        if name in _ENDS:
            self.end(*_ENDS[name])
        if name in _VOID:
            return
        parent = self.stack[-1] if self.stack else None
        key = (parent.role_hash if parent else 0, name, attributes)
        made = self.made.get(key)
        if made is None:
            made = self.made[key] = Element(name, attributes.removesuffix("/"), parent)
        self.stack.append(made)
        self.roles.append((made.role_hash, parent.role_hash if parent else 0, len(self.roles) + len(self.blocks)))

    def end(self, names: set[str], holders: frozenset[str] | set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name in names:
                del self.stack[k:]
                return
            if self.stack[k].name in holders:
                return

    def close(self, name: str) -> None:
        if name in _BLOCK:
            self.flush()
        elif name in _CELL:
            self.texts.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                return


def content(host: str, page: Page) -> int:
    """A hash of the host, the elements and the text that belongs to no menu or the like by name."""
    return hashed(f"{host} {[role for role, _, _ in page.roles]}{[b[1] for b in page.blocks if not (b[0] and b[0][-1].out)]}")


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, content) of each page, from (host, html, source)."""
    for b in batches:
        found = [content(host, Page(x.as_py())) for host, x in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(found, pa.int64())], names=["source", "content"])


def with_copies(rows: DataFrame) -> DataFrame:
    """(host, html, copies): how many pages of the host have the row's elements and text; null if no other has."""
    rows = rows.withColumn("source", F.xxhash64("host", "html"))
    pairs = written(rows.mapInArrow(fingerprints, "source long, content long"), "page-contents")
    many = written(pairs.groupBy("content").agg(F.count("*").alias("copies")).where("copies > 1"), "page-copies")
    sources = pairs.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, "content").groupBy("source").agg(F.max("copies").alias("copies"))
    sources = written(sources, "page-copies")
    return rows.join(F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources, "source", "left").select("host", "html", "copies")


def run_of(stack: tuple[Element, ...], text: str) -> int:
    """The token of a run of text: what it says, and where."""
    return hashed(f"{stack[-1].role_hash if stack else 0} {text}")


def tokens(page: Page) -> dict[int, list[int]]:
    """token -> [count, parent, 1 for a role and 0 for a run, first place] of a page."""
    found: dict[int, list[int]] = {}
    for role, parent, place in page.roles:
        found.setdefault(role, [0, parent, 1, place])[0] += 1
    for stack, text, _, place in page.blocks:
        found.setdefault(run_of(stack, text), [0, stack[-1].role_hash if stack else 0, 0, place])[0] += 1
    return found


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (host, token) for each page, of weight 1 over its copies; left and right: the terms of the token's vector."""
    for b in batches:
        columns: list[list] = [[] for _ in range(9)]
        for host, source, copies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            page, copies = Page(source.as_py()), copies or 1
            h = content(host, page) & ((1 << 64) - 1)
            part = pow(copies, -1, PRIME)  # a copy's share of a sum modulo the prime
            left, right = (h % PRIME) * part % PRIME, (h >> 31) % PRIME * part % PRIME
            for token, (count, parent, kind, place) in tokens(page).items():
                for column, x in zip(columns, (host, token, 1 / copies, count / copies, left * count % PRIME, right * count % PRIME, parent, kind, place / copies), strict=True):
                    column.append(x)
        types = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["host", "token", "pages", "count", "left", "right", "parent", "kind", "place"])


def host_of(url: str) -> F.Column:
    """The lower-case host of a URL; null if it has none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def classes(pages: DataFrame) -> DataFrame:
    """(host, all_pages, classes) of hosts of LEAST_PAGES distinct pages or more; a class: its pages, the count of each token
    and the tokens in order, from (host, html, copies) rows."""
    seen = pages.mapInArrow(counted, "host string, token long, pages double, count double, left long, right long, parent long, kind int, place double")
    # whole numbers but for the rounding of their sums
    sums = [*(F.round(F.sum(c)).cast("long").alias(c) for c in ("pages", "count")), *((F.sum(c) % PRIME).alias(c) for c in ("left", "right"))]
    vectors = seen.groupBy("host", "token").agg(*sums, F.max("parent").alias("parent"), F.max("kind").alias("kind"), (F.sum("place") / F.sum("pages")).alias("place"))
    vectors = written(vectors.where(f"kind = 1 or pages >= {LEAST_PAGES} * {TEMPLATE_SHARE}"), "page-vectors")
    hosts = vectors.where("kind = 1").groupBy("host").agg(F.max("pages").alias("all_pages")).where(f"all_pages >= {LEAST_PAGES}")
    often = vectors.join(hosts, "host").where(f"pages >= if(kind = 1, {ROLE_SHARE}, {TEMPLATE_SHARE}) * all_pages")
    token = F.struct("place", "token", "parent", "kind")
    equal = often.groupBy("host", "all_pages", "pages", "count", "left", "right").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    return equal.groupBy("host", "all_pages").agg(F.sort_array(F.collect_list(F.struct("pages", "count", "tokens")), asc=False).alias("classes"))


def nested(places: list[list[int | None]]) -> list[bool]:
    """Of classes with the places of their tokens on a page, those that this page speaks against: their tokens come in
    another order, or lie in several gaps of the first class."""
    first = [x for x in places[0] if x is not None] if places else []
    against = []
    for k, own in enumerate(places):
        here = [x for x in own if x is not None]
        gaps = {bisect(first, x) for x in here} if k else {0}
        against.append(any(x > y for x, y in zip(here, here[1:], strict=False)) or len(gaps) > 1)
    return against


def validated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, token, against, size, mass, heading, own) from pages with their host's classes.

    against: pages that speak against the class of that first token. Else of the innermost anchor around text: its
    characters that vary, those of them outside links, those in headings, and those of template runs.
    """
    known: dict[str, tuple] = {}
    for b in batches:
        found: dict[tuple[str, int], list[float]] = defaultdict(lambda: [0.0] * 5)
        for host, source, copies, every in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                once = [[t["token"] for t in c["tokens"]] for c in every.as_py() if c["count"] == c["pages"]]
                roles = {t["token"] for c in every.as_py() if c["count"] == c["pages"] for t in c["tokens"] if t["kind"] == 1}
                runs = {t["token"] for c in every.as_py() for t in c["tokens"] if t["kind"] == 0}
                known[host] = once, roles, runs
            (once, roles, runs), page, weight = known[host], Page(source.as_py()), 1 / (copies or 1)
            places = {t: x[3] for t, x in tokens(page).items()}
            for own, against in zip(once, nested([[places.get(t) for t in c] for c in once]), strict=True):
                if against:
                    found[host, own[0]][0] += weight
            for stack, text, linked, _ in page.blocks:
                at = next((e.role_hash for e in reversed(stack) if e.role_hash in roles), 0)
                sums = found[host, at]
                if run_of(stack, text) in runs:
                    sums[4] += weight * len(text)
                else:
                    sums[1] += weight * len(text)
                    sums[2] += weight * (len(text) - linked)
                    sums[3] += weight * len(text) * bool(stack and stack[-1].heading)
        keys = list(found)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([found[k][i] for k in keys], pa.float64()) for i in range(5))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "against", "size", "mass", "heading", "own"])


class Template:
    """The valid anchors of a host's classes, nested, with what their slots hold."""

    def __init__(self, every: list[dict], slots: dict[int, list[float]]):
        valid = [c["tokens"] for c in every if c["count"] == c["pages"] and slots.get(c["tokens"][0]["token"], [0.0])[0] <= (1 - TEMPLATE_SHARE) * c["pages"]]
        up = {t["token"]: t["parent"] for c in every for t in c["tokens"] if t["kind"] == 1}
        self.place = {t["token"]: t["place"] for c in valid for t in c if t["kind"] == 1}
        self.runs = sorted(t["token"] for c in every for t in c["tokens"] if t["kind"] == 0)

        def anchor(role: int) -> int:
            while role and role not in self.place:
                role = up.get(role, 0)
            return role

        #: 0 is the page itself; slots hold size, mass, heading, own
        self.parts: dict[int, list[int]] = defaultdict(list)
        for t in sorted(self.place, key=self.place.get):
            self.parts[anchor(up[t])].append(t)
        self.slot: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4)
        for t, sums in slots.items():
            if t == 0 or t in up:
                self.slot[anchor(t)] = [x + y for x, y in zip(self.slot[anchor(t)], sums[1:], strict=True)]
        size, _, _, own = (sum(s[k] for s in self.slot.values()) for k in range(4))
        if own >= VERSIONS_SHARE * (size + own) > 0:
            self.runs = []
            for t, s in self.slot.items():
                self.slot[t] = [s[0] + s[3], s[1] + s[3], s[2], 0.0]
        self.whole: dict[int, list[float]] = {}
        stack = [(0, False)]
        while stack:  # sums of whole parts, smallest first
            t, done = stack.pop()
            if done:
                self.whole[t] = [sum(x) for x in zip(self.slot[t], *(self.whole[c] for c in self.parts[t]), strict=True)]
            else:
                stack += [(t, True), *((c, False) for c in self.parts[t])]

    def fits(self, part: int) -> bool:
        """A part is no menu and not mostly the template's own text."""
        size, mass, _, own = self.whole[part]
        return mass >= FILLED_SHARE * size and own * FILLED_SHARE <= size * (1 - FILLED_SHARE)

    def holds(self, part: int, around: int) -> bool:
        """A part has text of weight, or a heading that varies."""
        size, mass, heading, _ = self.whole[part]
        return size > 0 and self.fits(part) and (mass >= WEIGHT * self.whole[around][1] or heading > 0.5 * size)

    def article(self) -> tuple[int, list[int]]:
        """The element that holds the article's slots (0: the page), and the parts in it that are none of the article's."""
        at = 0
        while True:
            held = [c for c in self.parts[at] if self.holds(c, at)]
            if len(held) != 1 or self.slot[at][1] >= WEIGHT * self.whole[at][1]:
                break
            at = held[0]
        out, below = [], list(self.parts[at])
        if held and self.slot[at][1] < WEIGHT * self.whole[at][1]:  # a frame: what stands around its parts isn't text's
            first, last = self.place[held[0]], self.place[held[-1]]
            out = [c for c in self.parts[at] if not first <= self.place[c] <= last]
        while below:  # menus and the like at any depth; template text alone goes by its runs
            t = below.pop()
            if self.whole[t][0] > 0 and not self.fits(t):
                out.append(t)
            else:
                below += self.parts[t]
        return at, sorted(set(out))


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, inside, parts, texts) from (host, classes, slots)."""
    for b in batches:
        found = []
        for host, every, slots in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            template = Template(every, {s["token"]: [s[c] for c in ("against", "size", "mass", "heading", "own")] for s in slots})
            found.append((host, *template.article(), template.runs))
        columns = zip(*found, strict=True) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["host", "inside", "parts", "texts"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, inside, parts, texts): of each host with a template the role of the element that holds the article's slots (0:
    the page), the roles in it that are none of the article's, and the template's runs of text, from all its pages."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).where("host is not null and html is not null")
    rows = with_copies(rows)
    found = written(classes(rows), "page-classes")
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.aggregate("classes", F.lit(0), lambda n, c: n + 16 + 32 * F.size(c["tokens"]))), F.lit(0)).alias("n")).first().n
    checked = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host").select("host", "html", "copies", "classes")
    sums = ("against", "size", "mass", "heading", "own")
    slots = checked.mapInArrow(validated, "host string, token long, " + ", ".join(f"{c} double" for c in sums)).groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in sums))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("token", *sums)).alias("slots"))
    return found.join(slots, "host").select("host", "classes", "slots").mapInArrow(decided, "host string, inside long, parts array<long>, texts array<long>")


def extract(source: str, inside: int | None = None, parts: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
    """The page's text: blocks in the article's slots, joined by empty lines; by markup alone where inside is null.

    A page without the element keeps all its slots. Headings of the template stay, since articles share them.
    """
    kept = [(stack, text) for stack, text, _, _ in Page(source).blocks if not (stack and stack[-1].out)]
    if inside is not None:
        roles = [{e.role_hash for e in stack} for stack, _ in kept]
        if inside and not any(inside in r for r in roles):
            inside = 0
        kept = [(stack, text) for (stack, text), r in zip(kept, roles, strict=True) if (not inside or inside in r) and not r & parts and (bool(stack) and stack[-1].heading or run_of(stack, text) not in texts)]
    return "\n\n".join(text for _, text in kept)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points of text) for each row of pages.

    A null or empty page has an empty text. A page without a host (null or odd URL), or of a host of under LEAST_PAGES
    distinct pages, of which no template can be known, keeps all blocks outside menus and the like by name. Pages of one
    host with equal elements and text count once; repeated rows are extracted each; a null id stays null; an empty table
    gives an empty one. Other columns aren't read.
    """
    found = written(templates(pages, url_col, html_col), "page-templates")
    size = found.agg(F.coalesce(F.sum(F.length("host") + 24 + 8 * (F.size("texts") + F.size("parts"))), F.lit(0)).alias("n")).first().n
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("__url"), F.col(f"`{html_col}`").cast("string").alias("__html"), host_of(url_col).alias("host"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("__id", "__url", "__html", "inside", "parts", "texts")
    kind = joined.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(2), *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)
            out = [extract(source.as_py() or "", inside, frozenset(parts or ()), frozenset(texts or ())) for source, inside, parts, texts in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")

"""DuckDB's SQL for the engine's queries: pieces that build on each other, each a function of the table it reads.

A source is a query with doc_id and text. Marks inside texts are characters that no text holds.
"""

from __future__ import annotations

import re

NL, HIDDEN = "chr(10)", "·"
ALNUM = r"[\p{L}\p{N}]"
DOCUMENTS = "select doc_id, coalesce(text, '') as text from documents"


def quoted(text: str) -> str:
    """A SQL string, line ends spelt out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def words(x: str) -> str:
    """White-space words with a letter or digit."""
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: regexp_matches(w, '{ALNUM}')))"


def runs(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{ALNUM}+')"


def matches(source: str, pattern: str) -> str:
    """(doc_id, text, k, s, m): a pattern's matches by place, from 0."""
    p = quoted(pattern)
    return f"""select doc_id, text, k, cast(sum(length(g)) over w + coalesce(sum(length(m)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as s, m
        from (select doc_id, text, unnest(m) as m, unnest(list_slice(g, 1, len(m))) as g, unnest(range(0, len(m))) as k
              from (select doc_id, text, regexp_extract_all(text, {p}) as m, string_split_regex(text, {p}) as g from ({source}))) window w as (partition by doc_id order by k)"""


def placed(found: str) -> str:
    """Adds line, col and byte offsets to (doc_id, text, s, m) rows."""
    return f"""select *, cast(octet_length(encode(left(text, s))) as int) as start_byte, cast(octet_length(encode(left(text, s + length(m)))) as int) as end_byte,
        cast(length(left(text, s)) - length(replace(left(text, s), {NL}, '')) + 1 as int) as line, cast(s - length(string_split(left(text, s), {NL})[-1]) as int) as line_at,
        cast(length(string_split(left(text, s), {NL})[-1]) + 1 as int) as col from ({found})"""


def sentences(source: str) -> str:
    """(doc_id, text, idx, s, e, t): sentences with a word by Unicode's rules, for texts with no abbreviations.

    1 and 2 mark where a full stop or another end may end a sentence; what follows takes some marks back.
    """
    tail = "[\"'')\\]}»”’]*[ \\t\\x{A0}]*"
    x = f"replace(replace(replace(text, {NL} || {NL}, chr(3) || chr(3)), {NL}, ' '), chr(3), {NL})"
    steps = [
        (r"([.!?。！？]+)", r"\1\x03"),
        (rf"\.\x03({tail})", r".\1\x01"),
        (rf"\x03({tail})", r"\1\x02"),
        (r"[\x01\x02]\n", r"\n"),
        (r"\.\x01([0-9])", r".\1"),
        (r"(\p{L}[.!?]*\.)\x01(\p{Lu})", r"\1\2"),
        (r"(\p{L}[.!?]*\.)\x01(\p{Lu})", r"\1\2"),
        (r"[\x01\x02]([,:;、-])", r"\1"),
        (r"\x01([^\p{L}\n.!?。！？\x01\x02]*\p{Ll})", r"\1"),
        (r"\n", r"\n\x02"),
    ]
    for pattern, by in steps:
        to = " || ".join("chr(10)" if p == r"\n" else f"chr({int(p[2:], 16)})" if p.startswith(r"\x") else f"'{p}'" for p in re.split(r"(\\x0[123]|\\n)", by) if p)
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return f"""select doc_id, text, row_number() over (partition by doc_id order by k) - 1 as idx, s, s + length(t) as e, t from (
        select doc_id, text, k, regexp_replace(p, '\\s+$', '') as t, cast(coalesce(sum(length(p)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as s
        from (select doc_id, text, unnest(p) as p, unnest(range(0, len(p))) as k from (select doc_id, text, string_split_regex({x}, '[\\x01\\x02]') as p from ({source})))
    ) where regexp_matches(t, '{ALNUM}')"""


def units(source: str, least: int) -> str:
    """Sentences of at least so many words, numbered anew."""
    return f"select doc_id, text, row_number() over (partition by doc_id order by idx) - 1 as u, s, e, t from ({sentences(source)}) where {words('t')} >= {least} and not (starts_with(t, '[') and ends_with(t, ']'))"


def shingle_set(w: str) -> str:
    k = f"(case when len({w}) >= 8 then 8 else 4 end)"
    return f"case when len({w}) >= 4 then list_distinct(list_transform(range(1, len({w}) - {k} + 2), lambda i: array_to_string(list_slice({w}, i, i + {k} - 1), ' '))) else [] end"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: on the bits of one integer if one has at most 120 words, the
    zeros of which it is in the end, else by rows."""
    x, y = f"(case when len({a}) <= len({b}) then {a} else {b} end)", f"(case when len({a}) <= len({b}) then {b} else {a} end)"
    full = f"((cast(1 as hugeint) << len({x})) - 1)"
    mask = f"cast(coalesce(list_sum(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i] = w), lambda i: cast(1 as hugeint) << (i - 1))), 0) as hugeint)"
    bits = f"(len({x}) - bit_count(list_reduce({y}, lambda r, w: ((r + (r & {mask})) | (r - (r & {mask}))) & {full}, {full})))"
    row = f"list_reduce(range(1, len({x}) + 1), lambda n, i: list_append(n, greatest(n[i], r[i + 1], case when {x}[i] = w then r[i] + 1 else 0 end)), [0])"
    rows = f"list_reduce({y}, lambda r, w: {row}, list_transform(range(0, len({x}) + 1), lambda i: cast(0 as int)))[-1]"
    return f"(case when least(len({a}), len({b})) <= 120 then {bits} else {rows} end)"


def pairs(source: str, threshold: float, distance: int = 200, least: int = 7, bar: float = 0.6) -> str:
    """(doc_id, text, a, b, sa, ea, sb, eb): near-verbatim units within a distance of white-space words."""
    return f"""with u as ({units(source, least)}),
    v as materialized (select doc_id, text, u, s, e, w, list_distinct(w) as d, {shingle_set('w')} as g, len(regexp_extract_all(left(text, s), '\\S+')) - case when regexp_matches(left(text, s), '\\S$') and s > 0 then 0 else 0 end as at from (select *, {runs('t')} as w from u)),
    c as materialized (select a.doc_id, a.text, a.u as a, b.u as b, a.s as sa, a.e as ea, b.s as sb, b.e as eb, a.w as wa, b.w as wb, a.g as ga, b.g as gb, least(len(a.w), len(b.w)) as least, len(list_intersect(a.d, b.d)) as same, least(len(a.d), len(b.d)) as kinds
          from v a join v b on a.doc_id = b.doc_id and a.u < b.u and b.at - a.at <= {distance}),
    j as (select *, case when len(ga) > 0 and len(gb) > 0 then len(list_intersect(ga, gb)) * 1.0 / len(list_distinct(list_concat(ga, gb))) else 0 end as jaccard from c where same + least - kinds >= {bar} * least or len(list_intersect(ga, gb)) > 0)
    select doc_id, text, a, b, sa, ea, sb, eb from j where jaccard >= {threshold} or (same + least - kinds >= {bar} * least and {lcs('wa', 'wb')} >= {bar} * least)"""


def members(found: str) -> str:
    """(doc_id, text, first, u, s, e): the members of the groups that (doc_id, text, a, b, sa, ea, sb, eb) pairs connect."""
    return f"""with recursive p as materialized ({found}), edges as (select doc_id, a, b from p union select doc_id, b, a from p),
    nodes as (select distinct doc_id, text, a as u, sa as s, ea as e from p union select doc_id, text, b, sb, eb from p),
    reach as (select doc_id, a as u, b as v from edges union select r.doc_id, r.u, g.b from reach r join edges g on g.doc_id = r.doc_id and g.a = r.v),
    named as (select doc_id, u, least(u, min(v)) as first from reach group by doc_id, u)
    select n.doc_id, n.text, first, u, n.s, n.e from named join nodes n using (doc_id, u)"""


def groups(found: str) -> str:
    """(doc_id, text, first, members, s, e): the groups, by their first."""
    return f"select doc_id, any_value(text) as text, first, count(*) as members, min(s) as s, arg_min(e, u) as e from ({members(found)}) group by doc_id, first"


def tokens(source: str) -> str:
    """(doc_id, text, k, s, m): words by Unicode's word rules: points join letters to letters and digits to digits."""
    return matches(source, r"[0-9]+(?:[.,;'’][0-9]+)+|(?:[\p{L}\p{N}_]*(?:\p{L}(?:['’.:·]\p{L})+|[0-9](?:[.,;'’][0-9])+))*[\p{L}\p{N}_]+|(?:[\p{L}\p{N}_]*(?:\p{L}(?:['’.:·]\p{L})+|[0-9](?:[.,;'’][0-9])+))+")

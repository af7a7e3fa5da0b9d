import random

import pytest

from prosemill.functions import stats, words
from prosemill.functions.eol import byte_offsets, line_col, normalize
from prosemill.functions.markdown import build_regions, mask_quoted


def test_line_ends():
    n = normalize("a\r\nb\rc")
    assert n.text == "a\nb\nc" and n.pairs == [1]
    assert n.span(0, 1) == (0, 1) and n.span(2, 3) == (3, 4) and n.span(0, len(n.text)) == (0, 6)
    assert line_col("ab\ncd", 4) == (2, 2) and byte_offsets("é—x", [0, 1, 2, 3]) == {0: 0, 1: 2, 2: 5, 3: 6}


@pytest.mark.parametrize(
    "text, hidden",
    [
        ("a `code` b", ["code"]),
        ("```\nall of it\n```\nafter", ["all of it"]),
        ("~~~\nnever closed", ["never closed"]),
        ("see [this](http://x.y/z) now", ["http://x.y/z"]),
        ("see http://x.y/z) now", ["http://x.y/z"]),
        ("mail <http://auto.link/a> end", ["auto.link"]),
        ("para\n\n    indented code\n\npara", ["indented code"]),
        ("[ref]: http://target.example\n\ntext", ["target.example"]),
    ],
)
def test_masks(text, hidden):
    masked = build_regions(text).masked
    assert len(masked) == len(text) and all(h not in masked for h in hidden)
    assert "after" in masked or "after" not in text


def test_scopes():
    r = build_regions("# Big Title\n\ntext\n\n- one\n- two\n  more\n\nend")
    assert r.scope_at(3) == "heading" and r.scope_at(14) == "prose" and r.scope_at(20) == "list-item"
    assert len(r.ranges("list-item")) == 2 and r.ranges("heading") == [(0, 11)]
    assert build_regions("Title\n===\n").ranges("heading")


def test_masking_keeps_length_and_line_ends():
    rng, parts = random.Random(3), ["word ", "`c` ", "\n", "\n\n", "```\n", "# h\n", "- i\n", "**b** ", "[a](b) ", "http://u.v ", "é—", "    x\n", "> q\n", "1. n\n"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        masked = build_regions(text).masked
        assert len(masked) == len(text) and all(m == t or m == "\0" and t != "\n" for m, t in zip(masked, text, strict=True))


def test_mentions():
    r = mask_quoted(build_regions('the "word" and “word” and "other"'), {"word"})
    assert r.masked.count("word") == 0 and "other" in r.masked and "“" in r.masked


def test_words():
    assert [w for _, _, w in words.tokens("It's well-known: 3.5% of A_B - ok")] == ["it's", "well", "known", "3.5", "of", "a_b", "ok"]
    assert words.word_count("one - two… 3") == 3 and words.lower_runs("A-b c1") == ["a", "b", "c1"]


@pytest.mark.parametrize(
    "text, n",
    [
        ("It cost $5.50 total. E.g. this.", 2),
        ("One. Two! Three? four", 3 + 1),
        ("He met Mr. Smith today. Then left.", 2),
        ("A line\nthat wraps. Next\n\nparagraph without end", 3),
        ("the U.S. economy grew. Then fell.", 2),
        ("wait... what is this", 1),
        ("", 0),
    ],
)
def test_sentences(text, n):
    assert len(words.sentences(text)) == n


def test_paragraphs():
    assert [("a b  c\n\n\nd\n\n--"[s:e]) for s, e in words.paragraphs("a b  c\n\n\nd\n\n--")] == ["a b  c", "d"]


def test_similarity():
    a, b = "the cat sat on the mat".split(), "the cat lay on a mat".split()
    assert words.lcs_length(a, b) == 4 and words.lcs_ratio(a, b) == 4 / 6 and words.lcs_ratio([], b) == 0
    assert len(words.shingles("a b c d e f g h i")) == 2 and len(words.shingles("a b c d e")) == 2 and not words.shingles("a b c")
    assert words.components(5, [(3, 1), (1, 4)]) == [[1, 3, 4]] and words.jaccard(frozenset("ab"), frozenset("bc")) == 1 / 3


def test_lcs_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2)]
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert words.lcs_length(a, b) == row[-1][-1]


def test_statistics():
    text = " ".join("a b c." if k % 2 else " ".join(["w"] * 17) + "." for k in range(40)).replace("a b c", "A b c").replace("w w", "W w", 0)
    found = stats.compute(build_regions("Start. " + text))
    assert found.word_count > 250 and 0.4 < stats.variation([3, 17] * 10) < 0.8 and round(stats.variation([3, 17] * 4), 1) == 0.7
    assert stats.variation([1, 2]) == 0 and stats.opener_run(["a b c", "A b d", "x", "a b"]) == 2 and stats.is_titlecase("## Big Plans For the World")
    dashes = stats.compute(build_regions("word — " * 300))
    assert round(dashes.get("em_dash_rate")) == 1000 and stats.compute(build_regions("a — b")).get("em_dash_rate") is None

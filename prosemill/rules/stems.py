"""Inflected forms of an English base word."""

from __future__ import annotations

_VOWELS = "aeiou"
#: Final consonants that double before -ed and -ing.
_DOUBLE = "bdgmnpt"


def _consonant_y(word: str) -> bool:
    return len(word) > 1 and word[-1] == "y" and word[-2] not in _VOWELS


def expand(term: str) -> list[str]:
    """The base with its -s, -ed and -ing forms, sorted; short or non-ASCII words stay alone."""
    base = term.strip().lower()
    if len(base) < 3 or not (base.isascii() and base.isalpha()):
        return [base]
    stem, forms = base[:-1], {base}
    doubles = base[-1] in _DOUBLE and base[-2] in _VOWELS and base[-3] not in _VOWELS
    if base.endswith(("s", "x", "z", "ch", "sh")):
        forms.add(base + "es")
    elif _consonant_y(base):
        forms |= {stem + "ies", base + "s"}
    else:
        forms.add(base + "s")
    if base[-1] == "e":
        forms |= {base + "d", stem + "ed", stem + "ing"}
    elif _consonant_y(base):
        forms |= {stem + "ied", base + "ed", base + "ing"}
    else:
        forms |= {base + "ed", base + "ing"}
        if doubles:
            forms |= {base + base[-1] + "ed", base + base[-1] + "ing"}
    return sorted(forms)

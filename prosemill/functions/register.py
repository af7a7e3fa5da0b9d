"""SQL functions of the engine, for spark.sql: Arrow-batched, and a table function that scans a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Scanner
from ..rules.model import Ruleset, Settings
from ..session import ship
from . import words
from .eol import normalize
from .markdown import build_regions


def _masked(text: str) -> str:
    return build_regions(normalize(text).text).masked


#: name -> (function of a text, type of its result).
FUNCTIONS = {
    "word_count": (words.word_count, "int"),
    "normalize_eol": (lambda t: normalize(t).text, "string"),
    "mask_markdown": (_masked, "string"),
    "visible_prose": (lambda t: _masked(t).replace("\0", " "), "string"),
    "sentences_of": (lambda t: [t[s:e] for s, e in words.sentences(t)], "array<string>"),
    "paragraphs_of": (lambda t: [t[s:e] for s, e in words.paragraphs(t)], "array<string>"),
    "words_of": (lambda t: [w for _, _, w in words.tokens(t)], "array<string>"),
    "content_words": (words.content_words, "array<string>"),
}


def _of_texts(f: Callable) -> Callable:
    """f over a column; nulls give nulls."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def register(spark: SparkSession, ruleset: Ruleset | None = None, settings: Settings | None = None) -> list[str]:
    """Registers FUNCTIONS, lcs_ratio(a, b) and, with a ruleset, the table function scan_findings(text). Nulls give nulls."""
    ship(spark)
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(_of_texts(f), kind))

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else words.lcs_ratio(words.lower_runs(x), words.lower_runs(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    spark.udf.register("lcs_ratio", F.pandas_udf(ratio, "double"))
    names = [*FUNCTIONS, "lcs_ratio"]
    if ruleset is not None:

        class ScanFindings:
            def __init__(self) -> None:
                self.scanner = Scanner(ruleset, settings)

            def eval(self, text: str) -> Iterator[tuple]:
                for f in self.scanner.scan(text)[0] if text is not None else ():
                    yield f.rule_id, f.tier, f.start, f.end, f.message

        spark.udtf.register("scan_findings", F.udtf(ScanFindings, returnType="rule_id string, tier int, start int, `end` int, message string"))
        names.append("scan_findings")
    return names

"""Native forms of the operators: Column expressions and DataFrame plans that Catalyst sees through.

They work on unmasked text; the fused scan in plans.engine is the one that knows markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = "[ \t\n\r]+"
ALNUM = "[\\p{L}\\p{N}]"
RUN = "[\\p{L}\\p{N}]+"
SENTENCE = "[^.!?\n]+[.!?]*"
TRICOLON = "\\b[a-z]+, [a-z]+, and [a-z]+\\b"


def words(text: Column) -> Column:
    """White-space words with a letter or digit."""
    return F.filter(F.split(text, SPACES), lambda w: w.rlike(ALNUM))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def count_of(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def floored(value: Column, count: Column, least: int) -> Column:
    """A statistic, null below its floor."""
    return F.when(count >= least, value)


def em_dash_rate(text: Column) -> Column:
    return count_of(text, "—") * F.lit(1000.0) / F.greatest(word_count(text), F.lit(1))


def curly_ratio(text: Column) -> Column:
    curly = count_of(text, "“") + count_of(text, "”")
    total = curly + count_of(text, '"')
    return F.when(total >= 20, curly / total).otherwise(0.0)


def bold_density(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?s)\\*\\*.*?\\*\\*")) * F.lit(100.0) / F.greatest(word_count(text), F.lit(1))


def runs(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))


def shingles(w: Column) -> Column:
    """Distinct runs of 8 words, of 4 for under 8 words, none for under 4."""
    k = F.when(F.size(w) >= 8, 8).otherwise(4)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= 4, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def member_excerpt(text: Column) -> Column:
    """White space collapsed, at most 80 characters and an ellipsis."""
    shown = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(F.length(shown) > 80, F.concat(F.left(shown, F.lit(80)), F.lit("…"))).otherwise(shown)


def units(docs: DataFrame, pattern: str = SENTENCE) -> DataFrame:
    """(doc_id, idx, unit): matches of a pattern that hold a word, trimmed, by place."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("idx", "unit"))
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), F.trim("unit").alias("unit")).where(F.col("unit").rlike(ALNUM))


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, token) by place."""
    return docs.select("doc_id", F.posexplode(runs(F.col("text"))).alias("idx", "token")).withColumn("idx", F.col("idx").cast("long"))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table: its size is that of the rules."""
    return spark.createDataFrame(rows, schema)


def vocab_hits(docs: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """(doc_id, idx, n, term, entry_id): at each token the longest term that starts there. terms: (term, entry_id).

    The longest is chosen within a document's row, of tokens that begin a term, so only hits leave it; the dictionary is
    as large as the rules, and its entries are joined by broadcast.
    """
    known: dict[int, list[str]] = {}
    for r in terms.select("term").distinct().collect():
        known.setdefault(r.term.count(" ") + 1, []).append(r.term)
    heads = sorted({t.split(" ")[0] for ts in known.values() for t in ts})

    def longest_at(head: Column, i: Column) -> Column:
        found = [(n, head if n == 1 else F.array_join(F.slice("w", i + 1, n), " ")) for n in sorted(known, reverse=True) if n <= longest]
        return F.coalesce(*[F.when(gram.isin(known[n]), F.struct(i.cast("long").alias("idx"), F.lit(n).cast("long").alias("n"), gram.alias("term"))) for n, gram in found])

    at = docs.select("doc_id", runs(F.col("text")).alias("w"))
    hits = F.filter(F.transform("w", lambda head, i: F.when(head.isin(heads), longest_at(head, i))), lambda h: h.isNotNull())
    return at.select("doc_id", F.inline(hits)).join(F.broadcast(terms), "term").select("doc_id", "idx", "n", "term", "entry_id")


def spans(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, k, start, matched) of a pattern's matches, which mustn't be empty: gaps and matches give the places, which
    are summed once in the row."""
    gaps, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = docs.select("doc_id", gaps.alias("gaps"), found.alias("found")).where(F.size("found") > 0)
    ends = F.aggregate(F.zip_with(F.slice("gaps", 1, F.size("found")), "found", lambda g, m: F.length(g) + F.length(m)), F.array(F.lit(0)), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))
    rows = rows.select("doc_id", "gaps", "found", ends.alias("ends"))
    starts = F.transform("found", lambda m, k: F.struct(k.cast("long").alias("k"), (F.get("ends", k) + F.length(F.get("gaps", k))).cast("long").alias("start"), m.alias("matched")))
    return rows.select("doc_id", F.inline(starts))


def streak(rows: DataFrame, key: str, order: str, same: Column) -> DataFrame:
    """(key, streak): the longest run of rows in order for which same holds of a row; islands by row numbers."""
    w = Window.partitionBy(key).orderBy(order)
    islands = rows.withColumn("__f", same).withColumn("__r", F.row_number().over(w)).where("__f")
    islands = islands.withColumn("__i", F.col("__r") - F.row_number().over(w))
    return islands.groupBy(key, "__i").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("streak"))


def without_overlaps(findings: DataFrame) -> DataFrame:
    """Findings (doc_id, fid, start, end) that overlap no other of their document."""
    others = findings.select("doc_id", F.col("fid").alias("o_fid"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    hit = (F.col("o_fid") != F.col("fid")) & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    return findings.join(others, (findings["doc_id"] == others["doc_id"]) & hit, "left_anti")

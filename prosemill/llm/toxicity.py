"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows: a token's score is the log of its odds in toxic against clean rows, under
an informative Dirichlet prior (what all rows hold, and a half), less a margin of standard errors and a constant, so
that ordinary text drifts downwards. A row counts a token once, however often it repeats it. A word too rare to judge
takes the score of its longest prefix that isn't; one that scores above 0 takes the highest of its own and prefixes'.

Score: one linear scan over a whole text finds all maximal-scoring segments. A segment's score S counts by the
extreme-value law of the maxima in clean text, E = K n exp(-lambda S): lambda solves sum p exp(lambda s) = 1 over the
clean rows' token scores and K is fitted to the clean rows' maxima. A document gathers lambda S - ln(K n) over its
segments, and a logistic curve fitted on the same sample turns that into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .labelled import labelled_sample
from .token_counts import by_bytes

#: Rows of the sample; rows with a word under which it isn't judged by itself.
MAX_ROWS, LEAST = 12_000, 6
PREFIXES = (7, 6, 5, 4)
#: Weight of the informative prior in tokens, and of the flat one; standard errors and log-odds taken off.
PRIOR, FLAT, MARGIN, DRIFT = 1000.0, 0.5, 2.58, 0.5
#: Score of a word that nothing is known of; bounds of lambda.
UNKNOWN, LAMBDA = -0.25, (0.05, 3.0)
THRESHOLD = 0.7
KNOWN = 300_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(word: str) -> list[str]:
    """The word, then its prefixes from the longest to the shortest, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The margin-adjusted log-odds ratio of a unit under the Dirichlet prior."""
    prior = PRIOR * (toxic + clean) / max(1, all_toxic + all_clean) + FLAT
    total = PRIOR + FLAT
    a, b = toxic + prior, clean + prior
    delta = math.log(a / max(all_toxic + total - a, 1.0)) - math.log(b / max(all_clean + total - b, 1.0))
    error = math.sqrt(1 / a + 1 / b)
    # towards 0 by the margin, never past it
    shrunk = math.copysign(max(0.0, abs(delta) - MARGIN * error), delta)
    return min(8.0, max(-2.0, shrunk)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in order: Ruzzo and Tompa's scan over runs of equal sign.

    Each segment kept has a link to the last one before it of a smaller sum before its start. What a search passes by
    is never looked at again, so the scan is linear.
    """
    if not len(scores) or not (scores > 0).any():
        return []
    sign = scores > 0
    edges = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    totals = np.add.reduceat(scores, starts)
    total, kept = 0.0, []  # kept: (first, end, sum before, sum at its end, link)
    for first, end, run in zip(starts.tolist(), ends.tolist(), totals.tolist(), strict=True):
        before, total = total, total + run
        if run <= 0:
            continue
        k = len(kept) - 1
        while True:
            while k >= 0 and kept[k][2] >= before:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= total:
                kept.append((first, end, before, total, k))
                break
            first, _, before, _, link = kept[k]
            del kept[k:]
            k = link
    return [(a, b, after - before) for a, b, before, after, _ in kept]


@dataclass
class Model:
    scores: dict[str, float]
    rate: float = 1.0  # lambda
    k: float = 0.1
    bias: float = -2.0
    slope: float = 1.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def token(self, word: str) -> float:
        known = self.model.scores
        found = [known[u] for u in units(word) if u in known] or [UNKNOWN]
        s = max(found) if found[0] > 0 else found[0]
        self.known[word] = s
        return s

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens and the maximal segments of a whole text."""
        words = words_of(text)
        if len(self.known) > KNOWN:
            self.known = {}
        known, token = self.known, self.token
        scores = np.fromiter((known[w] if w in known else token(w) for w in words), np.float64, len(words))
        met: dict[str, int] = {}
        for k in np.flatnonzero(scores > 0).tolist():  # repeats aren't independent: a token's k-th counts 1/k
            met[words[k]] = met.get(words[k], 0) + 1
            scores[k] /= met[words[k]]
        return len(words), segments(scores)

    def excess(self, n: int, score: float) -> float:
        """-ln E of a segment."""
        return self.model.rate * score - math.log(max(self.model.k * n, 1e-9))

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        """What the significant segments (E under 1) add up to, and those segments with their p-values."""
        n, found = self.scan(text)
        kept = [(a, b, s, -math.expm1(-math.exp(-x))) for a, b, s in found if (x := self.excess(n, s)) > 0]
        return sum(self.excess(n, s) for _, _, s, _ in kept), kept

    def score(self, evidence: float) -> float:
        z = self.model.bias + self.model.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def solved_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, within LAMBDA's bounds."""
    p, (low, high) = weights / weights.sum(), LAMBDA
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * scores) < 1 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), design.T @ (y - p) - 0.05 * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of toxic and of clean rows with each unit, summed over the task's rows."""
    found = {True: Counter(), False: Counter()}
    for b in batches:
        for text, label in zip(b.column(0), b.column(1), strict=True):
            found[label.as_py() > 0].update({u for w in set(words_of(text.as_py())) for u in units(w)})
    names = list(found[True].keys() | found[False].keys())
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([found[t][u] for u in part], pa.int64()) for t in (True, False))], names=["unit", "toxic", "clean"])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most max_rows rows of labelled_sample(). The units that LEAST of them hold and two numbers a row come to
    the driver; the rows themselves and their segments stay with the executors."""
    scratch = Scratch(docs.sparkSession, "toxic")
    sample = scratch.written(labelled_sample(docs, labels, label, max_rows), "sample").coalesce(16)
    counts = sample.mapInArrow(counted, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = counts.where(F.col("toxic") + F.col("clean") >= LEAST).toArrow().to_pydict()
    often = sorted(zip(often["unit"], often["toxic"], often["clean"], strict=True))
    words = [r for r in often if not r[0].endswith("*")]
    all_toxic, all_clean = max(1, sum(r[1] for r in words)), max(1, sum(r[2] for r in words))
    model = Model({unit: log_odds(toxic, clean, all_toxic, all_clean) for unit, toxic, clean in often})
    quiet = [(model.scores[unit], clean) for unit, _, clean in words if clean]
    if quiet:
        model.rate = solved_rate(*map(np.array, zip(*quiet, strict=True)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.scan(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64())), b.column(1)], names=["n", "all", "label"])

    rows = scratch.written(sample.mapInArrow(scanned, "n long, all array<double>, label int"), "segments")
    best = F.coalesce(F.array_max("all"), F.lit(0.0))
    law = rows.where("label <= 0 and n > 0").agg(F.count("*").alias("rows"), F.sum(F.col("n") * F.exp(-model.rate * best)).alias("expected")).first()
    if law.rows:
        model.k = law.rows / law.expected
    # as Scorer.excess() has it
    floor = F.log(F.greatest(model.k * F.col("n"), F.lit(1e-9)))
    evidence = F.aggregate("all", F.lit(0.0), lambda so_far, s: so_far + F.greatest(F.lit(0.0), model.rate * s - floor))
    judged = rows.select(F.log1p(evidence).alias("evidence"), (F.col("label") > 0).cast("double").alias("target")).toArrow().to_pydict()
    scratch.cleared("sample", "segments")
    evidence, target = np.array(judged["evidence"]), np.array(judged["target"])
    if 0 < target.sum() < len(target):
        model.bias, model.slope = logistic(evidence, target)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score (0 to 1), predicted (1 from THRESHOLD on) and passages, the significant
    segments with the numbers of their first and last word, score and p-value.

    A null text counts as empty; an empty one has no passages and scores by the curve's bias. A null id stays null
    and isn't held out. Repeated rows are scored each, an empty table gives an empty one, other columns aren't read.
    """
    side = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = side.schema[0].dataType.simpleString()
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores, passages = [], []
            for group in by_bytes(b.column(1)):
                for text in group:
                    evidence, found = scorer.evidence(text)
                    scores.append(scorer.score(evidence))
                    passages.append([{"first": a, "last": e - 1, "score": s, "p_value": p} for a, e, s, p in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(passages, passage)], names=[id_col, "score", "passages"])

    result = side.mapInArrow(score, f"`{id_col}` {kind}, score double, passages array<struct<first:bigint,last:bigint,score:double,p_value:double>>")
    return result.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")

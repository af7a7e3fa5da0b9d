"""Quality classifier by supervised subword embeddings.

A word's vector is the average of the learnt vectors of the word itself and of its character n-grams; a word that
repeats the one before it adds a mark, which has a vector too. A document is the average over its words and marks.
Features are hashed to a fixed number of rows. A softmax over a document's average gives the class. Vectors and output
are trained together by stochastic gradient descent in numpy, on the whole texts of a bounded sample of rows.

Since averages and output are linear, a trained model folds to one weight a feature. Each word's weight is computed
once and kept, so whole texts are scored at the cost of a lookup a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .labelled import labelled_sample
from .token_counts import by_bytes

#: Rows of the sample, hashed features, dimensions, passes, step size.
MAX_ROWS, BUCKETS, DIM, EPOCHS, RATE = 4000, 1 << 18, 8, 6, 0.2
NGRAMS = (3, 4, 5)
#: Words whose sums a worker keeps.
KNOWN = 300_000
SEED = 7
#: Words whose features are made at once: their arrays stay in the processor's cache.
AT_ONCE = 1500
_PRIME, _SHIFT, _MIX = np.uint32(16777619), np.uint32(0x51ED27), np.uint32(0x9E3779B1)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MIX
    h = (h ^ (h >> np.uint32(13))) * _MIX
    return (h >> np.uint32(14)).astype(np.int32) % np.int32(BUCKETS - 1)


#: The last row is the mark of a repeated word.
REPEATED = BUCKETS - 1


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the hashed features of each word, itself and the n-grams of it between marks of its ends."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int32, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    ends = np.cumsum(lengths, dtype=np.int32)
    place = np.arange(len(codes), dtype=np.int32) - (ends - lengths)[owner]
    left = lengths[owner] - place
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), _PRIME, np.uint32), dtype=np.uint32)
    whole = np.add.reduceat((codes + _SHIFT) * powers[place], ends - lengths) if len(words) else codes
    owners, buckets = [np.arange(len(words), dtype=np.int32)], [_bucket(whole)]
    h = codes * _PRIME
    for n in range(2, max(NGRAMS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * _PRIME
        if n in NGRAMS:
            fits = left[: len(h)] >= n
            owners.append(owner[: len(h)][fits])
            buckets.append(_bucket(h[fits] + np.uint32(n)))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """weights: of each feature; bias. A document's log-odds are the mean weight of its words and marks, and the bias."""

    weights: np.ndarray
    bias: float


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a document and their shares."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    total = np.zeros(BUCKETS)
    for k in range(0, len(words), AT_ONCE):
        owner, bucket = features(words[k : k + AT_ONCE])
        total += np.bincount(bucket, (1 / np.bincount(owner))[owner], BUCKETS)
    total[REPEATED] += repeats
    found = np.flatnonzero(total)
    return found.astype(np.int32), (total[found] / total.sum()).astype(np.float32)


def trained(rows: list[tuple[list[str], int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """The model of (words, label) rows."""
    return descended([(*bag(words), int(label > 0)) for words, label in rows], epochs, rate)


def descended(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over rows of (features, shares, label), each step scaled by its feature's past gradients."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    past = np.full(BUCKETS, 1e-8, np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    past_out = np.full((2, DIM), 1e-8, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            found, share, label = bags[k]
            mean = share @ vectors[found] if len(found) else np.zeros(DIM, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the loss by the softmax's inputs
            back = p @ out
            g = np.outer(p, mean)
            past_out += g * g
            out -= step * g / np.sqrt(past_out)
            bias -= step * 0.1 * p
            if len(found):
                past[found] += share * share * float(back @ back)
                vectors[found] -= (step * 0.1) * (share / np.sqrt(past[found]))[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; keeps the weights of words met before."""

    def __init__(self, model: Model):
        self.model, self.number, self.weights = model, {}, np.zeros(0, np.float64)

    def learn(self, words: list[str]) -> None:
        found = [self.weights]
        for k in range(0, len(words), AT_ONCE):
            owner, bucket = features(words[k : k + AT_ONCE])
            found.append(np.bincount(owner, self.model.weights[bucket]) / np.bincount(owner))
        self.weights = np.concatenate(found)
        base = len(self.number)
        self.number.update((w, base + k) for k, w in enumerate(words))

    def scores(self, texts: list[str]) -> list[float]:
        split = [t.split() for t in texts]
        new = {w for words in split for w in words} - self.number.keys()
        if len(self.number) + len(new) > KNOWN:
            self.__init__(self.model)
            new = {w for words in split for w in words}
        if new:
            self.learn(list(new))
        result, repeat = [], float(self.model.weights[REPEATED])
        for words in split:
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            repeats = int((at[1:] == at[:-1]).sum())
            size = len(words) + repeats
            z = self.model.bias + ((self.weights[at].sum() + repeats * repeat) / size if size else 0.0)
            result.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
        return result


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Trains on at most max_rows rows of labelled_sample(), whole texts, and returns the folded weights, 4 * BUCKETS bytes.

    Tasks make each row's features and shares, 8 bytes for each distinct feature; one executor task gathers those of the
    sample and trains. Without rows the model has no weights: every score is a half.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bag(x.as_py().split()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)), b.column(1)], names=["features", "shares", "label"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if rows:
            model = descended([(np.frombuffer(f, np.int32), np.frombuffer(s, np.float32), int(label > 0)) for f, s, label in rows])
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    rows = labelled_sample(docs, labels, label, max_rows).mapInArrow(bags, "features binary, shares binary, label int")
    found = rows.repartition(1).mapInArrow(train, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(found.weights), np.float32), found.bias) if found else Model(np.zeros(BUCKETS, np.float32), 0.0)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row of docs: id, held_out, score (0 to 1) and predicted (1 from 0.5 on); keep adds all columns of docs.

    A null or blank text has no features and scores by the bias alone. A null id stays null and isn't held out.
    Repeated rows are scored each, an empty table gives an empty one, and other columns are read only with keep,
    when columns of docs named as those made here are replaced.
    """
    made = ["held_out", "score", "predicted"]
    shown = [c for c in docs.columns if c not in made] if keep else [id_col]
    side = docs.select(*[F.col(f"`{c}`") for c in shown], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [s for group in by_bytes(b.column(b.num_columns - 1)) for s in scorer.scores(group)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], names=[*b.schema.names[:-1], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in side.schema.fields[:-1])
    result = side.mapInArrow(score, f"{schema}, score double")
    return result.select(*[F.col(f"`{c}`") for c in shown], held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

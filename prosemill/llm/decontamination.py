"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents give inverse frequencies.
2. Items are cut into passages of at most a window, each of which stands for its item, so that an item of any length
   meets windows part by part. The passages' TF-IDF rows are decomposed by a distributed randomised SVD: tasks return A'(A Omega) for a random
   Omega, whose sum spans the range; after orthogonalising, tasks return Q'A'(A Q), and its eigenvectors give the basis.
   A basis serves as many passages as it has vectors, so that it spans them and cosines in it are those of TF-IDF.
3. Every document is cut into overlapping windows of words. A window's latent vector, the sum of its words' rows of the
   basis, meets the passages' by cosine, or by the share of a passage's energy that it holds, which no words around a
   copy lessen: of a copy one of two windows holds half at least. A window whose words can't reach either by any passage
   is skipped first.
4. Around the windows that meet an item the longest common subsequence of words with the item decides: alone if it
   covers most of the item, else with the item's rarest words, its answer, nearly all there: a paraphrase.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a window and between two windows' beginnings; singular vectors kept; cosine that makes a candidate.
WINDOW, STRIDE, RANK, COSINE = 32, 16, 256, 0.25
#: Share of a passage's energy that makes a candidate too; under half, so that copies always are.
ENERGY = 0.45
#: Share of an item's words that a common subsequence must cover, alone (and one word more, which tells in short items) or
#: with this share of its answer's words.
COVERED, PARAPHRASED, ANSWERED = 0.6, 0.5, 0.8
#: Part of an item's distinct words that makes its answer; passages held by a task at once, more go in further passes.
ANSWER_PART, ITEMS = 0.25, 4096
SEED = 11
#: ASCII that parts words, as spaces, and punctuation beyond ASCII.
_PARTS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_BEYOND = re.compile("[\x80-©«-´¶-¹»-¿×÷‐-⁯、。　-〃「-】]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, in UTF-8, parted by white space and punctuation."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _BEYOND.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_PARTS).split()


@dataclass
class Block:
    """At most RANK passages and their basis. place: word -> row, 0 if no passage has the word; rows: the basis's rows
    times inverse frequency; latent: the passages' unit vectors; norms: their lengths before; most, most_energy: the most
    that each word gives to any's cosine and share of energy; owner: items."""

    place: np.ndarray
    rows: np.ndarray
    latent: np.ndarray
    norms: np.ndarray
    most: np.ndarray
    most_energy: np.ndarray
    owner: np.ndarray


@dataclass
class Index:
    """vocabulary: word -> number, of the whole benchmark; idf: inverse frequencies, the last that of all other words; blocks
    and items: those of one pass."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    blocks: list[Block]
    items: list[tuple[int, list[bytes]]]


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary is, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for b in batches:
            for x in b.column(0):
                found.update(vocabulary.keys() & set(words_of(x.as_py())))
                n += 1
        found[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {bytes(r.word): r.n for r in rows}
    return np.array([by_word.get(w, 0) for w in vocabulary], np.float64), int(by_word.get(b"", 0))


def passages(words: list[list[bytes]], vocabulary: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows."""
    a = np.zeros((len(words), len(vocabulary)), np.float32)
    for i, item in enumerate(words):
        for w, n in Counter(item).items():
            a[i, vocabulary[w]] = n * idf[vocabulary[w]]
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def basis(items: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int) -> np.ndarray:
    """The right singular vectors (vocabulary x rank) of the TF-IDF rows of passages (words joined by spaces)."""

    def summed(right: np.ndarray, left: np.ndarray | None) -> np.ndarray:
        """The sum over tasks of A'(A right), or of left'A'(A right)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    a = passages([x.split() for x in b.column(0).slice(at, 256).to_pylist()], vocabulary, idf)
                    part = (a if left is None else a @ left).T @ (a @ right)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["part"])

        shape = (right.shape[0] if left is None else left.shape[1], right.shape[1])
        found = np.zeros(shape, np.float32)
        for row in items.coalesce(16).mapInArrow(run, "part binary").toLocalIterator():
            found += np.frombuffer(row.part, "<f4").reshape(shape)
        return found

    rng = np.random.default_rng(SEED)
    over = min(len(vocabulary), rank + 16)
    q = np.linalg.qr(summed(rng.standard_normal((len(vocabulary), over)).astype(np.float32), None))[0]
    _, vectors = np.linalg.eigh(summed(q, q).astype(np.float64))
    return (q @ vectors[:, ::-1][:, :rank].astype(np.float32)).astype(np.float32)


def cut_up(words: list[bytes]) -> list[list[bytes]]:
    """Passages of at most WINDOW words, as even as can be, that make up an item."""
    n = -(-len(words) // WINDOW)
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


def block_of(spark: SparkSession, cut: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], idf: np.ndarray) -> Block:
    """cut: (item number, words) of at most RANK passages."""
    own = {w: k for k, w in enumerate(sorted({w for _, words in cut for w in words}))}
    at = np.fromiter((vocabulary[w] for w in own), np.int64, len(own))
    weights = idf[at]
    vectors = basis(spark.createDataFrame([(bytearray(b" ".join(words)),) for _, words in cut], "words binary"), own, weights, min(RANK, len(cut)))
    a = passages([words for _, words in cut], own, weights)
    norms = np.array([np.sqrt(sum((n * idf[vocabulary[w]]) ** 2 for w, n in Counter(words).items())) for _, words in cut])
    place, most, most_energy = np.zeros(len(idf), np.int32), np.zeros(len(idf)), np.zeros(len(idf))
    place[at] = np.arange(1, len(at) + 1)
    most[at] = a.max(axis=0) * weights
    most_energy[at] = (a / norms[:, None]).max(axis=0) * weights
    rows = np.concatenate([np.zeros((1, vectors.shape[1])), vectors * weights[:, None]]).astype(np.float32)
    return Block(place, rows, (a @ vectors).astype(np.float32), norms, most, most_energy, np.array([j for j, _ in cut]))


def indexed(docs: DataFrame, items: DataFrame, text_col: str) -> list[Index]:
    """The indexes of all passes. items: (item_id, text), few enough for the driver's memory. Vocabulary and frequencies are
    the whole benchmark's, so that no item's result depends on the others of its pass."""
    held = [(r.item_id, words_of(r.text)) for r in items.orderBy("item_id", "text").collect()]
    held = [(i, w) for i, w in held if w]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, item in held for w in item}))}
    counts, n = frequencies(docs, vocabulary, text_col)
    idf = np.log((n + 1) / (np.append(counts, 0) + 1)) + 0.05
    ends = np.cumsum([len(cut_up(w)) for _, w in held], dtype=np.int64)
    passes = (ends - 1) // ITEMS if held else ends
    found = []
    for k in np.unique(passes).tolist():
        part = [held[j] for j in np.flatnonzero(passes == k).tolist()]
        cut = [(j, words) for j, (_, w) in enumerate(part) for words in cut_up(w)]
        blocks = -(-len(cut) // RANK)
        found.append(Index(vocabulary, idf, [block_of(items.sparkSession, cut[b::blocks], vocabulary, idf) for b in range(blocks)], part))
    return found


def common(item: list[bytes], region: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    at: dict[bytes, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        hit = row & at.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.answers, self.distinct = [], [frozenset(item) for _, item in index.items]
        for _, item in index.items:
            rare = sorted(set(item), key=lambda w: (-index.idf[index.vocabulary[w]], w))
            self.answers.append(frozenset(rare[: max(3, int(len(rare) * ANSWER_PART))]))

    def candidates(self, words: list[bytes]) -> dict[int, dict[int, float]]:
        """Item number -> a window's first word -> cosine, of the windows that meet it."""
        x, n, other = self.index, len(words), len(self.index.vocabulary)
        firsts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        # a window is two strides, the last filled up with words that no item has
        ids = np.full((len(firsts) + 1) * STRIDE, other)
        ids[:n] = np.fromiter(map(x.vocabulary.get, words, repeat(other)), np.int64, n)
        ends = np.minimum(firsts + WINDOW, n)
        sums = np.concatenate([[0.0], np.cumsum(x.idf[ids] ** 2)])
        norms = np.sqrt(sums[ends] - sums[firsts]) + 1e-9
        found: dict[int, dict[int, float]] = {}
        for block in x.blocks:
            # no item gives a word more than its largest weight in any
            reach, energy = (np.concatenate([[0.0], np.cumsum(most[ids])]) for most in (block.most, block.most_energy))
            fit = np.flatnonzero((reach[ends] - reach[firsts] >= COSINE * norms) | (energy[ends] - energy[firsts] >= ENERGY))
            place = block.place[ids].reshape(-1, STRIDE)
            for k in range(0, len(fit), 512):
                part = fit[k : k + 512]
                strides = np.union1d(part, part + 1)
                at = np.searchsorted(strides, part)
                latent = block.rows[place[strides]].sum(axis=1)
                dots = (latent[at] + latent[at + 1]) @ block.latent.T
                cosines = dots / norms[part][:, None]
                for i, j in zip(*np.nonzero((cosines >= COSINE) | (dots >= ENERGY * block.norms)), strict=True):
                    windows, first = found.setdefault(int(block.owner[j]), {}), int(firsts[part[i]])
                    windows[first] = max(windows.get(first, 0.0), float(cosines[i, j]))
        return found

    def hits(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item id, cosine, share in common, share of the answer, first word of the region), the best of each item."""
        words = words_of(text)
        if not words or not self.index.items:
            return []
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for j, windows in self.candidates(words).items():
            item_id, item = self.index.items[j]
            met_to, further = -1, max(STRIDE, len(item) // 4)
            for first, cosine in sorted(windows.items()):
                if first <= met_to:
                    continue
                # the region has room for the item around each window that is passed over for this one
                start, met_to = max(0, first - len(item)), first + further
                region = words[start : met_to + WINDOW + len(item)]
                # what is in common counts distinct words and repeats of an item's words at most
                if len(self.distinct[j].intersection(region)) + len(item) - len(self.distinct[j]) < PARAPHRASED * len(item):
                    continue
                share = common(item, region) / len(item)
                answer = len(self.answers[j] & set(region)) / len(self.answers[j])
                if share >= COVERED + 1 / len(item) or share == 1 or share >= PARAPHRASED and answer >= ANSWERED:
                    now = (item_id, cosine, share, answer, start)
                    best[item_id] = max(best.get(item_id, now), now, key=lambda h: (h[2], h[3], h[1], -h[4]))
        return [best[i] for i in sorted(best)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_share, first_word) of each document and item that it holds.

    Null or empty texts and items hold nothing and are in nothing; null ids are carried. Repeated rows of docs give
    their rows each; of items with one id the best counts. An empty table on either side gives an empty result. Other
    columns aren't read. Benchmarks of over ITEMS passages are searched in several passes of about that many.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    side = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = side.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    result = None
    for index in indexed(docs, items, text_col):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(index)
            for b in batches:
                rows = [(k, *hit) for k, x in enumerate(b.column(1)) for hit in searcher.hits(x.as_py())]
                at, item, cosine, share, answer, first = zip(*rows, strict=True) if rows else ((),) * 6
                columns = [pa.array(item, pa.int64()), *(pa.array(c, pa.float64()) for c in (cosine, share, answer)), pa.array(first, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=[id_col, "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

        found = side.mapInArrow(search, schema)
        result = found if result is None else result.unionByName(found)
    return side.sparkSession.createDataFrame([], schema) if result is None else result

"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's set of word shingles gives a signature of minima and a digest; documents of equal sets are one
   class, numbered as a node, which the text of its smallest id stands for.
2. Bands of a signature are keys; classes that share one are candidates. In each key the class whose keys are the
   largest, the likely original of a group, leads: all others meet it, as many pairs as rows, however large the group.
3. A pair's signatures are compared batch by batch. It is pruned as soon as the posterior probability that it is
   similar enough, under a uniform prior, falls below a miss probability. Of the leaders that survive, each class is
   verified against the one of most equal signatures, on full sets. These links make trees, whose roots are labels.
4. In a key that still holds several labels, all classes outside the most frequent one meet all members. Such classes
   and members of one label are one group, whatever keys they share, and meet in blocks within Python functions: first
   signatures, of which only the classes that survive with any other are returned; then full sets of these, of which
   only the links that join labels are returned. So rows stay in proportion to a group's classes times its blocks.
5. Connected components of the links.

What is missed: a pair at the threshold that shares no band, (1 - t^ROWS)^BANDS, and MISS by the pruning.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature values compared between two looks at the posterior; miss probability of each pair.
BATCH, MISS = 32, 1e-6
#: Signatures that a block holds, and those that pass by it.
BLOCK, PASSING = 2048, 8192
#: Shingles of full sets that a block holds, and those that pass by it.
HELD, SHOWN = 1 << 20, 1 << 22
KNOWN_WORDS = 300_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RNG = np.random.default_rng(20240229)
_MUL, _ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class Shingler:
    """Hashed sets of k-word shingles; words are lower-cased in A-Z and parted by ASCII white space."""

    def __init__(self, k: int):
        self.k, self.known = k, {}
        self.buffer = np.empty((256, HASHES), np.uint32)

    def words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def set(self, text: str) -> np.ndarray:
        """The sorted distinct shingles; of fewer than k words, the whole sequence as one; of none, nothing."""
        h = self.words(text)
        if not len(h):
            return h
        k = min(self.k, len(h))
        n = len(h) - k + 1
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s = (s ^ (s >> np.uint64(29))) * _A + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(32))) * _C
        return np.unique(s)

    def signature(self, s: np.ndarray) -> np.ndarray:
        short = ((s * _C) >> np.uint64(32)).astype(np.uint32)
        least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), len(self.buffer)):
            part = short[at : at + len(self.buffer)]
            out = self.buffer[: len(part)]
            np.multiply(part[:, None], _MUL, out=out)
            np.add(out, _ADD, out=out)
            np.minimum(least, out.min(axis=0), out=least)
        return (least >> np.uint32(8)).astype("<u2")  # 16 bits of each value are kept


def signed(k: int):
    """Rows (id, mark, n, digest, signature) of (id, mark, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            sizes, digests, signatures = [], [], []
            for x in b.column(2):
                s = shingler.set(x.as_py() or "")
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(shingler.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "mark", "n", "digest", "signature"])

    return run


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BANDS rows (key, node) of each class."""
    for b in batches:
        if not b.num_rows:
            continue
        m = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), m.shape[:2]).copy()
        for i in range(ROWS):
            key = (key ^ (key >> np.uint64(31))) * _A + m[:, :, i] * _C
        key ^= key >> np.uint64(32)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "node"])


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed): fewer leave P(similarity >= threshold) below miss.

    With a uniform prior and m matches of n the posterior is Beta(m + 1, n - m + 1), whose tail above t is
    P(Binomial(n + 1, t) <= m).
    """
    table = []
    for n in sorted({*range(BATCH, HASHES, BATCH), HASHES}):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        table.append((n, m))
    return table


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of signatures (rows of left and right) the numbers of those that no batch prunes."""
    alive, matches, before = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, need in least_matches(threshold):
        matches = matches + (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
        fine = matches >= need
        alive, matches, before = alive[fine], matches[fine], n
    return alive


def pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and signatures allow the similarity, and their number of equal values."""
    sides = [classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in ("a", "b")]
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(fits).select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 3))
                kept = survivors(left, right, percent / 100)
                equal = pa.array((left[kept] == right[kept]).sum(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(kept)) for i in (0, 1)), equal], names=["a", "b", "equal"])

    return joined.mapInArrow(run, "a long, b long, equal int")


def in_blocks(members: DataFrame, held: Column, shown: Column) -> DataFrame:
    """(main, role, node, label) rows dealt to blocks (main, i, j): those that are held (role 0) to one i and all j, those
    that are shown to them (role 1) to one j and all i. held and shown: of each group the number of blocks."""
    blocks = members.groupBy("main").agg(F.greatest(F.lit(1), held).cast("int").alias("n_i"), F.greatest(F.lit(1), shown).cast("int").alias("n_j"))
    h = F.xxhash64("node")
    i = F.when(F.col("role") == 0, F.array(F.pmod(h, "n_i").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("n_i") - 1))
    j = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("n_j") - 1)).otherwise(F.array(F.pmod(h, "n_j").cast("int")))
    rows = members.join(blocks, "main").withColumns({"i": i, "j": j})
    return rows.withColumn("i", F.explode("i")).withColumn("j", F.explode("j")).drop("n_i", "n_j")


def sized(role: int, per: int, column: Column | None = None) -> Column:
    """Blocks for so many rows of a role, or for the sum of a column of them."""
    return F.ceil(F.sum(F.when(F.col("role") == role, F.lit(1) if column is None else column).otherwise(0)) / per)


def met(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the members (main, role, node, label) of each group those that survive with one of the other role and another
    label."""
    at = ["main", "i", "j"]
    dealt = in_blocks(members, sized(0, BLOCK), sized(1, PASSING)).join(classes.select("node", "n", "signature"), "node")
    rows = dealt.select(*at, "role", "node", "label", "n", "signature").repartition(*at).sortWithinPartitions(*at, "role")

    def out(main: int | None, held: list[tuple], seen: np.ndarray, others: list[tuple[int, int]]) -> pa.RecordBatch:
        found = [(main, 0, held[k][0], held[k][1]) for k in np.flatnonzero(seen).tolist()] + [(main, 1, *x) for x in others]
        columns = zip(*found, strict=True) if found else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["main", "role", "node", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready, seen, others = [None], [], None, np.zeros(0, bool), []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(7)]
            for *at_block, role, node, label, n, signature in zip(*columns, b.column(7).to_pylist(), strict=True):
                if at_block != block:
                    yield out(block[0], held, seen, others)
                    block, held, ready, seen, others = at_block, [], None, np.zeros(0, bool), []
                mine = np.frombuffer(signature, "<u2")
                if role == 0:
                    held.append((node, label, n, mine))
                    continue
                if ready is None:
                    if not held:
                        continue
                    ready, seen = tuple(np.array(x) for x in zip(*held, strict=True)), np.zeros(len(held), bool)
                _, labels, sizes, signatures = ready
                fit = np.flatnonzero((labels != label) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                if len(fit):
                    fit = fit[survivors(signatures[fit], np.broadcast_to(mine, (len(fit), HASHES)), percent / 100)]
                if len(fit):
                    seen[fit] = True
                    others.append((node, label))
        yield out(block[0], held, seen, others)

    return rows.mapInArrow(run, "main long, role int, node long, label long").distinct()


class Block:
    """Full sets by their shingles, to count what another set has in common with each."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]):
        self.nodes, labels = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        self.sizes = np.array([len(h[2]) for h in held], np.int64)
        every, owner = np.concatenate([h[2] for h in held]), np.repeat(np.arange(len(held), dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.shingles, self.start = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(every)))
        #: a label's root; the roots of those held
        self.up: dict[int, int] = {}
        self.roots = labels

    def common(self, s: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        at = at[self.shingles[at] == s]
        ends, total, k = np.cumsum(self.count[at]), np.zeros(len(self.nodes), np.int64), 0
        while k < len(at):  # few postings at once
            before = ends[k - 1] if k else 0
            to = max(k + 1, int(np.searchsorted(ends, before + at_once, "right")))
            part = self.count[at[k:to]]
            places = np.repeat(self.start[at[k:to]] - (ends[k:to] - part - before), part) + np.arange(ends[to - 1] - before)
            total += np.bincount(self.owner[places], minlength=len(total))
            k = to
        return total

    def root(self, label: int) -> int:
        while label in self.up:
            label = self.up[label]
        return label

    def links(self, node: int, label: int, s: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Of the links between node and those held one for each label that they join."""
        both = self.common(s)
        fine = (100 * both >= percent * (self.sizes + len(s) - both)) & (self.nodes != node)
        mine, found = self.root(label), []
        roots, at = np.unique(self.roots[fine], return_index=True)
        for r, k in zip(roots.tolist(), np.flatnonzero(fine)[at].tolist(), strict=True):
            if r != mine:
                found.append((int(self.nodes[k]), node))
                self.up[r] = mine
                self.roots[self.roots == r] = mine
        return found


def linked(members: DataFrame, classes: DataFrame, source: DataFrame, percent: int, k: int) -> DataFrame:
    """The links (a, b) by full sets between the two roles of each group of members (main, role, node, label), as many as
    join all labels that links of a block join. source: (id, mark, text)."""
    at = ["main", "i", "j"]
    sizes = members.join(classes.select("node", "n", "id", "mark"), "node")
    held, shown = F.greatest(sized(0, HELD, F.col("n")), sized(0, BLOCK)), sized(1, SHOWN, F.col("n"))
    cell = [*at, "role", "node", "label"]
    # one text of a node, where rows repeat
    texts = in_blocks(sizes, held, shown).join(source, ["id", "mark"]).select(*cell, "text").dropDuplicates(cell)
    rows = texts.repartition(*at).sortWithinPartitions(*at, "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, held, block = Shingler(k), None, [], None
        for b in batches:
            found: list[tuple[int, int]] = []
            columns = [b.column(i).to_pylist() for i in range(6)]
            for *at_block, role, node, label, text in zip(*columns, b.column(6), strict=True):
                if at_block != now:
                    now, held, block = at_block, [], None
                if role == 0:
                    held.append((node, label, shingler.set(text.as_py() or "")))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(held)
                if (block.roots != block.root(label)).any():
                    found += block.links(node, label, shingler.set(text.as_py() or ""), percent)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, more: bool = False) -> DataFrame:
    """Per row of docs: the id, n_shingles, component_id (the smallest id that links reach) and kept (it is that one).

    Two texts are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles. A text of fewer
    words has its whole sequence as one shingle; an empty or null text has none and is linked with nothing: its
    component is its own id. Rows that repeat an id are rows of their own with that id. A null id names no component:
    such a row gets that of the texts it is linked with, if they have one, and isn't kept. An empty table gives an
    empty one. Other columns aren't read. Ids are longs. more adds mark, the xxhash64 of the text, and group_id, a
    number of the linked group that no other shares, null without shingles.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).select("id", F.xxhash64("text").alias("mark"), "text")
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.written(source.mapInArrow(signed(k), "id long, mark long, n long, digest binary, signature binary"), "signatures")
    named = rows.where("n > 0 and id is not null")
    # sizes and signatures follow from the digest
    firsts = named.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = scratch.written(firsts.select(F.monotonically_increasing_id().alias("node"), "first.id", "first.mark", "n", "digest", "signature"), "classes")

    keys = classes.select("node", "signature").mapInArrow(banded, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keys = scratch.written(keys.join(shared, "key"), "bands")
    weights = keys.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = keys.join(weights, "node").groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("a"))
    pairs = keys.join(leaders, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    survived = scratch.written(pruned(pairs, classes, percent), "survivors")

    best = survived.groupBy("b").agg(F.max(F.struct("equal", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    led = best.select(F.col("a").alias("main"), F.lit(0).alias("role"), F.col("a").alias("node")).distinct().unionByName(best.select(F.col("a").alias("main"), F.lit(1).alias("role"), F.col("b").alias("node")))
    first_links = scratch.written(linked(led.withColumn("label", F.col("node")), classes, source, percent, k), "trees")
    # leaders weigh more than those they lead: the links are trees, and each step doubles the height they are climbed
    labels = first_links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    for _ in range(2):
        labels = labels.join(labels.toDF("label", "above"), "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    labels = scratch.written(labels, "labels")

    def labelled(df: DataFrame, node: str, label: str) -> DataFrame:
        return df.join(labels.toDF(node, "__label"), node, "left").withColumn(label, F.coalesce("__label", node)).drop("__label")

    member = labelled(keys.select("key", "node"), "node", "label")
    most = member.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("members"), F.count("*").alias("parts"))
    # leaders have met all others: two classes have met
    member = member.join(most.where("parts > 1 and members > 2").select("key", F.col("most.label").alias("main")), "key").select("main", "node", "label").distinct()
    roles = F.when(F.col("label") == F.col("main"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    member = scratch.written(member.select("main", F.explode(roles).alias("role"), "node", "label"), "groups")
    # other leaders that survived
    left = labelled(labelled(survived.select("a", "b"), "a", "main"), "b", "label").where("main <> label").select("main", "a", "b", "label")
    left = left.select("main", F.lit(0).alias("role"), F.col("b").alias("node"), "label").unionByName(left.select("main", F.lit(1).alias("role"), F.col("a").alias("node"), F.col("main").alias("label")))
    apart = scratch.written(met(member, classes, percent).unionByName(left).distinct(), "apart")
    links = scratch.written(first_links.unionByName(linked(apart, classes, source, percent, k)), "links")
    found = components(links)
    scratch.cleared("bands", "survivors", "trees", "labels", "groups", "apart", "links")

    least = found.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    found = found.join(least, "component").select("node", "component", "component_id")
    named_class = classes.select("digest", "node", "id").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("group_id"), F.coalesce("component_id", "id").alias("component_id"))
    result = rows.select("id", "mark", "n", "digest").join(named_class, "digest", "left")
    component = F.coalesce("component_id", "id")
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")]
    return result.select(*columns, *[F.col(c) for c in ("mark", "group_id") if more])


#: near_duplicates(k=2) over whole tables in DuckDB.
SQL = r"""
with recursive w as (
    select row_number() over () as r, doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), s as (
    select r, doc_id, list_sort(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
           else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as s
    from w
), classes as (
    select min(doc_id) as id, s, len(s) as n from s where len(s) > 0 group by s
), grams as (
    select id, n, unnest(s) as gram from classes
), pairs as (
    select a.id as a, b.id as b from grams a join grams b on a.gram = b.gram and a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as (
    select a, b from pairs union select b, a from pairs union select id, id from classes
), reach as (
    select a as node, b as other from edges
    union
    select reach.node, edges.b from reach join edges on reach.other = edges.a
), found as (
    select node, min(other) as component from reach group by node
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(f.component, s.doc_id) as component_id,
       coalesce(s.doc_id = coalesce(f.component, s.doc_id), false) as kept
from s left join classes c on len(s.s) > 0 and s.s = c.s left join found f on f.node = c.id
"""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosemill.llm import near_dedup as near
from prosemill.llm import substring_dedup as sub
from prosemill.llm.components import components


def near_slow(rows, k, percent):
    sh = near.Shingler(k)
    sets = [frozenset(sh.set(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(least.get(root(i), doc))) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    rows = []
    for doc in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((doc * 7 % 1009, " ".join(words)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "a b"), (2006, "A B"), (2007, "é b"), (2008, "É b"), rows[0], (2009, rows[3][1].upper())]


@pytest.mark.parametrize("k, percent, seed", [(2, 80, 1), (5, 80, 2), (2, 60, 3)])
def test_near_duplicates(spark, k, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n int, kept boolean")
    got = near.near_duplicates(docs, k=k, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_slow(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_star(spark):
    """Copies of a hub that aren't alike among themselves, and one that only they reach."""
    rng = random.Random(9)
    hub = [f"h{k}" for k in range(200)]
    rows = [(500, " ".join(hub))]
    for doc in range(60):
        words = list(hub)
        for k in rng.sample(range(200), 9):
            words[k] = f"x{doc}-{k}"
        rows.append((doc, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near.near_duplicates(docs, k=2).collect())
    assert got == near_slow(rows, 2, 80)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """A group that no leader spans, dealt to blocks of a few classes."""
    for name, value in (("BLOCK", 5), ("PASSING", 9), ("HELD", 700), ("SHOWN", 900)):
        monkeypatch.setattr(near, name, value)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for doc in range(90):  # a chain: each text is like its neighbours only
        words = list(base)
        for k in range(doc % 45, doc % 45 + 24):
            words[k] = f"y{k}"
        if doc >= 45:
            words[rng.randrange(120)] = f"z{doc}"
        rows.append((doc, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near.near_duplicates(docs, k=k).collect())
        assert got == near_slow(rows, k, 80)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rng = random.Random(3)
    a, b = ([f"{x}{rng.randrange(1000)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "end"])), (3, " ".join([*b, "end"])), (3, " ".join([*b, "end"])), (4, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(docs, k=2, more=True).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_slow(rows, 2, 80)
    assert len({r.group_id for r in got}) == 3  # the two texts of id 1 lead two groups


def test_blocks_count_what_sets_share():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    block = near.Block([(k, k, s) for k, s in enumerate(sets)])
    for s in sets:
        want = [len(np.intersect1d(s, x)) for x in sets]
        assert block.common(s).tolist() == want and block.common(s, at_once=7).tolist() == want


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near.near_duplicates(nulls, k=2).collect())
    assert got == [("3", "3", True), ("None", "3", False), ("None", "None", False)]


def test_pruning_bounds():
    for n, need in near.least_matches(0.8, 1e-6):
        # by the binomial tail: at the threshold, fewer matches than needed are rarer than the miss probability
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.8, 20_000) < need).mean() < 1e-3 and need < 0.8 * n


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    assert got == {x: m for x, m in least.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sub_slow(rows):
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        smaller = set()
        for other, t in rows:
            if doc is not None and other is not None and other < doc:
                d = (t or "").encode()
                smaller |= {d[i : i + 50] for i in range(len(d) - 49)}
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if data[i : i + 50] in smaller:
                gone[i : i + 50] = True
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(doc), len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_substrings(spark, seed):
    rng = random.Random(seed)
    letters = "ab " if seed == 0 else "abcdefgh éñ\n"
    parts = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 49, 50, 51, 80, 200]))) for _ in range(12)]
    rows = [(rng.randrange(60), "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 7)))) for _ in range(50)]
    rows += [(70, None), (71, ""), (None, parts[-1] * 2), (72, parts[5] * 30), (73, "x" * 200), (74, "x" * 120), (75, "\0" * 60), (76, "\0" * 55), rows[3]]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_bytes int")
    got = sub.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sub_slow(rows)


def test_substrings_keep_text(spark):
    docs = spark.createDataFrame([(1, "k" + "a" * 60, "x"), (2, "a" * 60 + " rest é", "y"), (3, None, "z")], "doc_id long, text string, kept_text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in sub.deduplicated(docs, keep_text=True).collect()}
    assert got[2].kept_text == " rest é" and got[2].n_removed == 60 and got[3].text is None and got[3].n_bytes == 0
    assert sub.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 400)).astype(np.uint8)
    order = sub.suffix_array(text, 50)
    data = text.tobytes()
    assert sorted(order.tolist()) == list(range(len(text)))
    keys = [data[i : i + 50] for i in order]
    assert keys == sorted(keys)
    got = sub.common_prefixes(text, order)
    assert np.array_equal(got, sub.common_prefixes(text, order, lanes=7))
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        n = 0
        while n < min(len(a), len(b), 50) and a[n] == b[n]:
            n += 1
        assert got[k] == n


@pytest.mark.parametrize("seed", range(6))
def test_common_prefixes_of_long_repeats(seed):
    """Repeats that are longer than suffixes are sorted by, of which the next bytes order them otherwise."""
    rng = np.random.default_rng(seed)
    long = [rng.integers(97, 123, rng.integers(90, 300)) for _ in range(3)]
    text = np.concatenate([np.concatenate([rng.integers(97, 123, rng.integers(0, 40)), long[rng.integers(3)][rng.integers(0, 20) :]]) for _ in range(60)]).astype(np.uint8)
    order, data = sub.suffix_array(text), text.tobytes()
    want = [0] * len(order)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :][:50], data[order[k] :][:50]
        want[k] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for lanes in (1, 5, 4096):
        assert sub.common_prefixes(text, order, lanes=lanes).tolist() == want


def test_substrings_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in sub.deduplicated(docs).collect()}
    seen: set[bytes] = set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        data = (r.text or "").encode()
        windows, gone = [data[k : k + 50] for k in range(len(data) - 49)], np.zeros(len(data), bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(windows)
        rest = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[r.doc_id] == (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())


def test_segments_differ_by_any_bit_of_their_hashes(monkeypatch):
    """Segments of one anchor whose hashes share their high or their low half aren't taken as equal."""
    hashes = {b"a": 7 << 32 | 1, b"b": 7 << 32 | 2, b"c": 9 << 32 | 1, b"d": 7 << 32 | 1}
    one = lambda x, kind: np.array([x], kind)
    monkeypatch.setattr(sub, "anchors", lambda text: (one(5, np.uint64), one(hashes[text.tobytes()], np.uint64), one(0, np.int64), one(0, np.int64), one(1 << 16, np.uint32)))
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([b"a", b"b", b"c", b"d"])], names=["id", "data"])
    got = {}
    for b in sub.judged(1)(sub.offered(1)(iter([docs]))):
        for ids, flags in zip(b.column("ids").to_pylist(), b.column("flags").to_pylist(), strict=True):
            got |= dict(zip(sub.unplaned(ids).tolist(), (np.frombuffer(flags, np.uint8) & 1 > 0).tolist(), strict=True))
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_claims_of_equal_hashes_are_held_against_the_bytes(spark, monkeypatch):
    """Hashes only route: where all segments of an anchor get one hash, what differs still stays."""
    real = sub.anchors
    monkeypatch.setattr(sub, "anchors", lambda text: (lambda g, s, a, b, c: (g, g, a, b, c))(*real(text)))
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = letters(40)  # too short to cover anything, long enough for equal anchors
    rows = [(k, letters(60) + shared + letters(60)) for k in range(20)] + [(30, letters(9) + rows_text) for rows_text in [letters(200)]]
    rows += [(31, rows[-1][1] + letters(5))]
    source = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows], pa.binary())], names=["id", "data"])
    verdicts = list(sub.judged(1)(sub.offered(1)(iter([source]))))
    assert sum(int((np.frombuffer(f, np.uint8) == 0).sum()) for b in verdicts for f in b.column("flags").to_pylist()) > 20  # false claims among them
    wide = [(0, 0, None, None, *x, None) for b in verdicts for x in zip(*(b.column(c).to_pylist() for c in ("ids", "keys", "owners", "flags")))]
    wide += [(0, 1, k, 0, None, None, None, None, t.encode()) for k, t in rows]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    table = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*wide), types)], names=list("abcdefghi"))
    wanted = sorted((r["key"], 0, 0, r["id"], r["mark"], r["first"], r["data"]) for b in sub.opened(iter([table])) for r in b.to_pylist())
    block = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*wanted)], names=list("abcdefg"))
    spans = [tuple(r.values()) for b in sub.resolved(iter([block])) for r in b.to_pylist()]
    assert {s[0] for s in spans} == {31} and sub.joined(np.array([s[2] for s in spans]), np.array([s[3] for s in spans]))[1].tolist() == [209]


def test_substrings_in_many_blocks(spark, monkeypatch):
    """One anchor's segments and one owner's claims over several parts, blocks of several shards."""
    monkeypatch.setattr(sub, "PART", 3000)
    monkeypatch.setattr(sub, "PIECE", 700)
    monkeypatch.setattr(sub, "SHARD", 1500)  # in this process; executors keep theirs
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    gram, passage = text(24), text(900)
    rows = [(k, text(rng.randint(0, 30)) + gram + text(rng.randint(0, 30)) + text(20)) for k in range(150)]
    rows += [(200 + k, text(rng.randint(0, 40)) + passage + text(rng.randint(0, 40))) for k in range(40)]
    rows += [(300 + k, rows[k][1][5:] + rows[k + 60][1]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sub.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sub_slow(rows)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_whole_in_any_batches(seed, monkeypatch):
    """Spans don't depend on how rows come in batches, nor on which blocks share a shard."""
    monkeypatch.setattr(sub, "SHARD", 900)
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(25):
        passage = rng.integers(97, 120, 70).astype(np.uint8).tobytes()
        rows += [(key, 0, 0, 100 * key + k, 5, 3 * k, bytes([65 + k]) + passage[: 70 - k % 3] + bytes([97 + k])) for k in range(int(rng.choice([1, 2, 5, 20])))]
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdefg"))
    want = None
    for size in (1, 7, 64, len(rows)):
        got = sorted(tuple(r.values()) for b in sub.resolved(table.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist())
        want = want or got
        assert got == want and len(got) > 10


def test_shards_of_a_block_merge(monkeypatch):
    monkeypatch.setattr(sub, "SHARD", 400)
    rng = np.random.default_rng(8)
    passage = rng.integers(97, 120, 130).astype(np.uint8).tobytes()
    rows = [(k, 0, 10 * k, rng.integers(97, 120, 89).astype(np.uint8).tobytes() + bytes([65 + k]) + passage) for k in range(9)]
    columns = [np.array(c) for c in zip(*(r[:3] for r in rows))]
    found = sub.solved([(*columns, np.array([len(r[3]) for r in rows]), b"".join(r[3] for r in rows))])
    assert sorted(zip(*(c.tolist() for c in found))) == [(k, 0, 10 * k + 90, 10 * k + 220) for k in range(1, 9)]


def test_shards_merge():
    a, b = b"p" * 10 + b"the same fifty bytes stand in both of these shards, yes", b"the same fifty bytes stand in both of these shards, yes"
    first = sub.Shard(np.array([9]), np.array([1]), np.array([100]), np.array([len(a)]), a)
    second = sub.Shard(np.array([4]), np.array([2]), np.array([0]), np.array([len(b)]), b)
    first.merge(second)
    second.merge(first)
    spans = lambda shard: list(zip(*(c.tolist() for c in shard.covered())))
    assert spans(first) == [(9, 1, 110, 100 + len(a))] and spans(second) == []


def test_long_texts_make_the_same_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 120, 300).astype(np.uint8)
    long = np.concatenate([rng.integers(97, 120, 2 * sub.CHUNK - 150).astype(np.uint8), passage, rng.integers(97, 120, 99).astype(np.uint8)])
    grams = set(sub.anchors(passage)[0].tolist())
    assert grams <= set(sub.anchors(long)[0].tolist())
    g, s, first, last, _ = sub.anchors(long)
    assert first[0] == 0 and last[-1] == len(long) - 50 and (first[1:] == last[:-1] + 1).all()

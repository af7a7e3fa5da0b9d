"""Exact removal of repeated byte strings by suffix arrays.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller id.

1. Anchors: of the grams (GRAM bytes) in a window of LENGTH bytes the one of least hash is its anchor. Equal windows
   have equal anchors at equal places. The windows next to each other that share an anchor make a segment.
2. Routing: segments meet by anchor, as hashes only, which decide where bytes go. An anchor of one document can't
   repeat. Of segments with equal hashes the smallest document's is the owner; the others claim to repeat it. A segment
   that stands alone though its anchor doesn't may share windows with the others of its anchor: with those that have
   the same SIDE bytes before or after it, as any window has so many on one side of its anchor.
3. Bytes: the runs of segments that claim one owner go to that owner's runs, those that stand alone to their anchor.
   What is too much for one block is dealt to parts that meet in pairs, so blocks are of bounded size.
4. Suffix arrays decide what is covered, of all bytes but runs that equal another's byte for byte: each shard of at most SHARD bytes gets one by Larsson and
   Sadakane's refinement, which sorts groups not yet sorted by the ranks h further on; Kasai's common prefixes, carried
   along the text, show the runs of equal windows, and each run's smallest document. Shards of one block are merged by
   binary search in each other's sorted windows.
5. The covered spans of a document are joined and cut out.

Work and traffic grow with the input, and as the square of the parts of an anchor's segments only where these fill
several blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH, GRAM = 50, 24
#: Bytes of which each window has so many before its anchor or after it.
SIDE = (LENGTH - GRAM) // 2
#: Grams of a window; positions hashed at once; bytes of a batch of anchors; text for each bucket and each group.
SPAN, CHUNK, BATCH, BUCKET_BYTES, GROUP_BYTES = LENGTH - GRAM + 1, 1 << 15, 8 << 20, 4 << 20, 4 << 20
#: Bytes of a shard: three ranks fit in one 63-bit key.
SHARD_BITS = 21
SHARD = (1 << SHARD_BITS) - 64
#: Bytes of a part, of which two make a block; of a row of a run, which overlap by a window.
PART, PIECE = 2 << 20, 1 << 18
#: Bytes of rows for each partition.
PARTITION = 8 << 20
#: Rows of bytes that stand alone, claim an owner's, or are an owner's.
ALONE, CLAIM, OWNER = 0, 1, 2
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LETTERS = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(int(_B), CHUNK + LENGTH + 1)
_DOWN = _powers(pow(int(_B), -1, 1 << 64), CHUNK + LENGTH + 1)


def side(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 to 65535 for the SIDE bytes from each place on."""
    return (mixed((sums[at + SIDE] - sums[at]) * _DOWN[at]) >> np.uint64(48)).astype(np.int64) % 65535 + 1


def anchors(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text: (gram hash, segment hash, first window, last window, sides) of each segment, in order. sides: 16 bits of
    a hash of the bytes before the anchor and 16 of those after it, each 0 if no window of the segment has SIDE of them."""
    n = len(text) - LENGTH + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n, CHUNK):
        windows = min(CHUNK, n - at)
        part = text[at : at + windows + LENGTH - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTERS[part] * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
        grams = len(part) - GRAM + 1
        hashes = mixed((sums[GRAM:] - sums[:grams]) * _DOWN[:grams])
        order = (hashes & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(grams, dtype=np.uint64)
        least, width = order, 1
        while width * 2 <= SPAN:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:windows], least[SPAN - width : SPAN - width + windows])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        place = (least[first] & np.uint64(0xFFFF)).astype(np.int64)
        segment = mixed((sums[last + LENGTH] - sums[first]) * _DOWN[first] + (place - first).astype(np.uint64) * _M2)
        ends = place + GRAM
        before = np.where(place - first >= SIDE, side(sums, np.maximum(place - SIDE, 0)), 0)
        after = np.where(place - last <= LENGTH - GRAM - SIDE, side(sums, np.minimum(ends, len(part) - SIDE)), 0)
        found.append((hashes[place], segment, first + at, last + at, (before << 16 | after).astype(np.uint32)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def low_half(gram: np.ndarray) -> np.ndarray:
    """What goes with a segment's hash, to find the segments of one gram: the half that buckets aren't made by."""
    return (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def planes(ids: np.ndarray) -> bytes:
    """Longs by byte planes, which compress well when they grow slowly."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def as_bytes(x: pa.Scalar) -> np.ndarray:
    data = x.as_buffer() if x.is_valid else None
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, slices of the columns) by bucket, orders kept."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), *(c[part] for c in columns)


def offered(buckets: int):
    """Rows (bucket, ids, grams, keys, sides): the distinct segments of each document, by their whole hashes, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> pa.RecordBatch:
            ids, grams, keys, sides, bucket = (np.concatenate(x) for x in zip(*waiting, strict=True))
            rows = [(b, planes(i), g.tobytes(), k.tobytes(), s.tobytes()) for b, i, g, k, s in dealt(bucket, ids, grams, keys, sides)]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "ids", "grams", "keys", "sides"])

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                gram, segment, _, _, sides = anchors(as_bytes(x))
                if len(gram):
                    keys, at = np.unique(segment, return_index=True)
                    waiting.append((np.full(len(keys), doc, np.int64), low_half(gram[at]), keys, sides[at], bucket_of(gram[at], buckets)))
                    size += len(keys)
                if size * 24 >= BATCH:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()

    return run


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[list]]]:
    """(bucket, lists of the other columns' values) from batches sorted by bucket."""
    at, held = None, [[] for _ in range(columns)]
    for b in batches:
        names = b.column(0).to_pylist()
        values = [b.column(i + 1).to_pylist() for i in range(columns)]
        for k, name in enumerate(names):
            if name != at and held[0]:
                yield at, held
                held = [[] for _ in range(columns)]
            at = name
            for i in range(columns):
                held[i].append(values[i][k])
    if held[0]:
        yield at, held


def shared(gram: np.ndarray, part: np.ndarray, segment: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """If a row's part, which isn't 0, is that of another segment of its gram too, in several documents."""
    if not len(gram):
        return np.empty(0, bool)
    group = gram.astype(np.uint64) << np.uint64(16) | part
    order = np.argsort(group, kind="stable")  # segments stay in order
    group, found = group[order], np.empty(len(gram), bool)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    heads, at = np.flatnonzero(new), np.cumsum(new) - 1
    least, most, first, last = (f.reduceat(x[order], heads) for x in (ids, segment) for f in (np.minimum, np.maximum))
    found[order] = ((least < most) & (first < last))[at] & (part[order] > 0)
    return found


def judged(groups: int):
    """Rows (group, ids, keys, owners, flags) for the segments whose bytes are wanted. flags: 1 for those that stand alone,
    2 for owners, their sum for both; 0 for those that claim to repeat an owner's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (all_ids, all_grams, all_keys, all_sides) in grouped(batches, 4):
            ids = np.concatenate([unplaned(x) for x in all_ids])
            gram, keys = np.concatenate([np.frombuffer(x, np.uint32) for x in all_grams]), np.concatenate([np.frombuffer(x, np.uint64) for x in all_keys])
            sides = np.concatenate([np.frombuffer(x, np.uint32) for x in all_sides])
            order = np.lexsort((ids, keys, gram))
            ids, keys, gram, sides = ids[order], keys[order], gram[order], sides[order]
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new_key = new_gram | np.concatenate([[True], keys[1:] != keys[:-1]])
            heads, which = np.flatnonzero(new_key), np.cumsum(new_key) - 1
            owners = ids[heads][which]  # of each segment
            last = ids[np.append(heads[1:], len(ids)) - 1][which]
            at = np.cumsum(new_gram) - 1
            segments = np.bincount(at, new_key)
            least, most = (f.reduceat(ids, np.flatnonzero(new_gram)) for f in (np.minimum, np.maximum))
            claims = ids > owners
            open_ = np.flatnonzero((segments[at] > 1) & (least[at] < most[at]))
            alone = np.zeros(len(ids), bool)
            for part in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
                alone[open_] |= shared(gram[open_], part[open_], which[open_], ids[open_])
            flags = (~claims & alone).astype(np.uint8) + 2 * (~claims & (last > owners)).astype(np.uint8)
            wanted = claims | (flags > 0)
            if not wanted.any():
                continue
            ids, keys, owners, flags = ids[wanted], keys[wanted], owners[wanted], flags[wanted]
            group = (mixed(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)
            rows = [(g, planes(i), k.tobytes(), planes(o), f.tobytes()) for g, i, k, o, f in dealt(group, ids, keys, owners, flags)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["group", "ids", "keys", "owners", "flags"])

    return run


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.concatenate([at[1:], [len(starts)]]) - 1] if len(at) else ends


def runs(chosen: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the segments next to each other that are chosen and have one owner."""
    at = np.flatnonzero(chosen)
    if len(at):
        cuts = np.flatnonzero((np.diff(at) > 1) | (owners[at[1:]] != owners[at[:-1]])) + 1
        for part in np.split(at, cuts):
            yield int(part[0]), int(part[-1])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a group's verdicts (kind 0) and texts (kind 1): rows (key, kind, id, mark, first, data) of wanted bytes."""
    group, verdicts, ready = None, [], None
    out: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "kind", "id", "mark", "first", "data"])

    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(8)]
        for g, kind, doc, mark, ids, keys, owners, flags, x in zip(*columns, b.column(8), strict=True):
            if g != group:
                group, verdicts, ready = g, [], None
            if kind == 0:
                verdicts.append((unplaned(ids), np.frombuffer(keys, np.uint64), unplaned(owners), np.frombuffer(flags, np.uint8)))
                continue
            if not verdicts:
                continue
            if ready is None:
                columns_of = [np.concatenate(c) for c in zip(*verdicts, strict=True)]
                order = np.lexsort((columns_of[1], columns_of[0]))
                ready = [c[order] for c in columns_of]
            lo, hi = np.searchsorted(ready[0], [doc, doc + 1])
            if lo == hi:
                continue
            text = as_bytes(x)
            gram, segment, first, last, _ = anchors(text)
            at = np.minimum(np.searchsorted(ready[1][lo:hi], segment), hi - lo - 1) + lo
            met, owner, flag = ready[1][at] == segment, ready[2][at], ready[3][at]
            wanted = [(ALONE, gram[k].astype(np.int64).item(), k, k) for k in np.flatnonzero(met & (flag & 1 > 0)).tolist()]
            for kind_of, chosen in ((CLAIM, met & (flag == 0)), (OWNER, met & (flag & 2 > 0))):
                wanted += [(kind_of, mixed(owner[i : i + 1].astype(np.uint64)).astype(np.int64).item(), i, j) for i, j in runs(chosen, owner)]
            for kind_of, key, i, j in wanted:
                s, e = int(first[i]), int(last[j]) + LENGTH
                for s in range(s, max(s + 1, e - LENGTH + 1), PIECE - LENGTH + 1):
                    data = text[s : min(e, s + PIECE)].tobytes()
                    out.append((key, kind_of, doc, mark, s, data))
                    size += len(data) + 64
            if size >= BATCH:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes in order of their first depth bytes at least, by Larsson and Sadakane's refinement."""
    n = len(text)
    mask = np.uint64((1 << SHARD_BITS) - 1)
    padded = np.concatenate([text, np.zeros(5, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(5):
        key = (key << np.uint64(8)) | padded[i : n + i]
    key = np.sort((key << np.uint64(SHARD_BITS)) | np.arange(n, dtype=np.uint64))
    order = (key & mask).astype(np.int64)
    key >>= np.uint64(SHARD_BITS)
    slots, rank, h = np.arange(n), np.zeros(n, np.int64), 5
    new = np.concatenate([[True], key[1:] != key[:-1]])
    while True:
        heads = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = heads
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        if not len(slots) or h >= depth:
            return order
        p = order[slots]
        ahead = np.where(p + h < n, rank[np.minimum(p + h, n - 1)] + 1, 0)
        both = (rank[p].astype(np.uint64) << np.uint64(2 * SHARD_BITS)) | (ahead.astype(np.uint64) << np.uint64(SHARD_BITS)) | p.astype(np.uint64)
        both.sort()
        order[slots] = (both & mask).astype(np.int64)
        both >>= np.uint64(SHARD_BITS)
        new = np.concatenate([[True], both[1:] != both[:-1]])
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = LENGTH, lanes: int = 1 << 14) -> np.ndarray:
    """For each suffix in order the length, up to cap, of its common prefix with the one before it.

    Kasai's scan: along the text the length falls by one at most from a suffix to the next, so it is carried and only what
    is beyond it is compared, a word of 8 bytes at once. That holds of suffixes that differ within the depth they are
    sorted by; after a length of cap, which may be a tie, nothing is carried. The text is cut into lanes that are scanned
    side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + cap + 8, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(word)]
    steps = -(-n // lanes)
    result, length, starts = np.zeros(n, np.int64), np.zeros(lanes, np.int64), np.arange(lanes) * steps
    bounds = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)
    for step in range(steps):
        here = starts + step
        lane = np.flatnonzero(here < n)
        here = here[lane]
        other = before[here]
        h = np.where((other >= 0) & (length[lane] < cap), np.maximum(length[lane] - 1, 0), 0)
        grow = np.flatnonzero(other >= 0)
        while len(grow):
            differ = word[here[grow] + h[grow]] ^ word[other[grow] + h[grow]]
            more = 8 - np.searchsorted(bounds, differ, "right") - (differ != 0)
            h[grow] += more
            grow = grow[(more == 8) & (h[grow] < cap)]
        h = np.minimum(h, np.minimum(cap, n - np.maximum(here, other)))
        result[here] = length[lane] = h
    return result[order]


class Shard:
    """Sorted distinct windows of one shard, with the smallest document of each."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: bytes):
        text = np.frombuffer(data, np.uint8)
        order = suffix_array(text)
        owner = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        window = (place <= lengths[owner] - LENGTH)[order]
        prefix = common_prefixes(text, order)
        # suffixes that aren't windows stand between: a run lasts while no prefix since its head falls short
        run = np.cumsum(prefix < LENGTH)[window]
        at = order[window]
        new = np.concatenate([[True], run[1:] != run[:-1]])
        self.run, self.owner, self.place = (x.astype(np.int32) for x in (np.cumsum(new) - 1, owner[at], place[at]))
        self.ids, self.marks, self.starts = ids, marks, starts
        heads = np.flatnonzero(new)
        self.least = np.minimum.reduceat(ids[self.owner], heads)
        self.text, self.heads = text, at[heads]

    def windows(self) -> np.ndarray:
        """The sorted distinct windows themselves: LENGTH times the text, so made where two shards meet and not kept."""
        windows = np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)
        return np.ascontiguousarray(windows[self.heads]).view(f"S{LENGTH}").reshape(-1)

    def merge(self, other: Shard) -> None:
        """Takes over the smaller documents of windows that the other shard has, found by binary search."""
        mine, theirs = self.windows(), other.windows()
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        same = theirs[at] == mine
        self.least = np.where(same, np.minimum(self.least, other.least[at]), self.least)

    def covered(self) -> tuple[np.ndarray, ...]:
        """(document, mark, start, end) of joined covered spans."""
        hit = self.least[self.run] < self.ids[self.owner]
        owner, place = self.owner[hit].astype(np.int64), self.place[hit].astype(np.int64)
        order = np.argsort(owner << SHARD_BITS | place)
        owner, place = owner[order], place[order]
        # windows of one segment next to each other are one span
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]) if len(owner) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(owner)]]) - 1 if len(heads) else heads
        at = owner[heads]
        return self.ids[at], self.marks[at], self.starts[at] + place[heads], self.starts[at] + place[tails] + LENGTH


#: Rows side by side: ids, marks, first places, lengths, and all their bytes.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]


def solved(parts: list[Rows]) -> tuple[np.ndarray, ...]:
    """Covered spans (id, mark, first, last) of rows: shards, merged if there are several. Of rows with equal bytes those of
    the smallest document stand for all; the others are covered."""
    ids, marks, firsts, lengths = (np.concatenate([p[k] for p in parts]) for k in range(4))
    data = parts[0][4] if len(parts) == 1 else b"".join(p[4] for p in parts)
    ends = np.cumsum(lengths)
    pieces = [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for piece, i in zip(pieces, ids.tolist(), strict=True):
        if i < least.get(piece, i + 1):
            least[piece] = i
    equal = np.fromiter((i > least[piece] for piece, i in zip(pieces, ids.tolist(), strict=True)), bool, len(ids))
    covered = [(ids[equal], marks[equal], firsts[equal], firsts[equal] + lengths[equal])]
    if equal.any():
        data = b"".join(piece for piece, e in zip(pieces, equal.tolist(), strict=True) if not e)
        ids, marks, firsts, lengths = (x[~equal] for x in (ids, marks, firsts, lengths))
        ends = np.cumsum(lengths)
    shards, k = [], 0
    while k < len(ids):
        before = int(ends[k - 1]) if k else 0
        to = max(k + 1, int(np.searchsorted(ends, before + SHARD, "right")))
        shards.append(Shard(ids[k:to], marks[k:to], firsts[k:to], lengths[k:to], data[before : int(ends[to - 1])]))
        k = to
    for a in shards:
        for b in shards:
            if a is not b:
                a.merge(b)
    return tuple(np.concatenate(c) for c in zip(*covered, *(shard.covered() for shard in shards), strict=True))


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans (id, mark, first, last) from rows (key, i, j, id, mark, first, data), sorted by block. Small blocks
    share a shard: windows that equal each other are repeats wherever they come from. No block is parted."""
    held: list[Rows] = []
    size, block = 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in solved(held)], names=["id", "mark", "first", "last"])

    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        ids, marks, firsts = (b.column(k).to_numpy() for k in (3, 4, 5))
        data = b.column(6)
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        values = memoryview(data.buffers()[2]) if data.buffers()[2] is not None else memoryview(b"")
        begins = np.flatnonzero(np.concatenate([[block is None or bool((at[0] != block).any())], (at[1:] != at[:-1]).any(axis=1)]))
        p, n = 0, len(ids)
        while p < n:
            if size + offsets[n] - offsets[p] <= SHARD:
                to = n
            else:  # as many blocks as a shard takes, or one that is larger
                later = begins[np.searchsorted(begins, p, "left" if held else "right") :]
                fit = later[size + offsets[later] - offsets[p] <= SHARD]
                to = int(fit[-1]) if len(fit) else int(later[0]) if len(later) else n
            if to > p:
                held.append((ids[p:to], marks[p:to], firsts[p:to], np.diff(offsets[p : to + 1]), bytes(values[offsets[p] : offsets[to]])))
                size += int(offsets[to] - offsets[p])
            if to < n:
                yield out()
                held, size = [], 0
            p = to
        block = at[-1]
    if held:
        yield out()


def in_blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of wanted bytes dealt to blocks (key, i, j). A key's rows that stand alone are dealt to parts of which each two
    meet; its claims and its owner's are dealt to parts of which each of one kind meets each of the other."""
    size = F.octet_length("data").cast("long")
    parts = rows.groupBy("key").agg(*(F.sum(F.when(F.col("kind") == k, size).otherwise(0)).alias(f"n{k}") for k in (ALONE, CLAIM, OWNER)))
    large = parts.where(" or ".join(f"n{k} > {PART}" for k in (ALONE, CLAIM, OWNER))).select("key", *(F.greatest(F.lit(1), F.ceil(F.col(f"n{k}") / PART)).cast("int").alias(f"n{k}") for k in (ALONE, CLAIM, OWNER)))
    # a table, whose size is known: rows needn't be shuffled to meet a small one
    found = rows.join(scratch.written(large, "large"), "key", "left")
    every = lambda k: F.sequence(F.lit(0), F.col(f"n{k}") - 1)
    part = lambda k: F.pmod(F.xxhash64("id", "first"), f"n{k}").cast("int")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    blocks = F.when(F.col("n0").isNull(), F.array(pair(F.lit(0), F.lit(0))))
    blocks = blocks.when(F.col("kind") == ALONE, F.transform(every(ALONE), lambda q: pair(F.least(part(ALONE), q), F.greatest(part(ALONE), q))))
    blocks = blocks.when(F.col("kind") == CLAIM, F.transform(every(OWNER), lambda j: pair(part(CLAIM), j))).otherwise(F.transform(every(CLAIM), lambda i: pair(i, part(OWNER))))
    return found.withColumn("block", F.explode(blocks)).select("key", F.col("block.i").alias("i"), F.col("block.j").alias("j"), "id", "mark", "first", "data")


def covered_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, first, last): spans of bytes of each document, not yet joined, that a smaller document's strings cover.

    mark is a hash of the text: rows that repeat an id with other texts keep their own spans.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8").alias("data")).where(f"id is not null and octet_length(data) >= {LENGTH}")
    total = source.agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0)).alias("n")).first().n
    buckets, groups = max(64, total // BUCKET_BYTES), max(64, total // GROUP_BYTES)
    partitions = int(max(8, total // PARTITION))
    offers = source.mapInArrow(offered(buckets), "bucket int, ids binary, grams binary, keys binary, sides binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    verdicts = scratch.written(offers.mapInArrow(judged(groups), "group int, ids binary, keys binary, owners binary, flags binary"), "verdicts")

    scratch.settled()

    def grouping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((mixed(ids) % np.uint64(groups)).astype(np.int32)), *b.columns], names=["group", "id", "data", "mark"])

    nothing, no_number = F.lit(None).cast("binary"), F.lit(None).cast("long")
    texts = source.withColumn("mark", F.xxhash64("data")).mapInArrow(grouping, "group int, id long, data binary, mark long")
    texts = texts.select("group", F.lit(1).alias("kind"), "id", "mark", *(nothing.alias(c) for c in ("ids", "keys", "owners", "flags")), "data")
    asked = verdicts.select("group", F.lit(0).alias("kind"), no_number.alias("id"), no_number.alias("mark"), "ids", "keys", "owners", "flags", nothing.alias("data"))
    both = asked.union(texts).repartition(partitions, "group").sortWithinPartitions("group", "kind")
    found = scratch.written(both.mapInArrow(opened, "key long, kind int, id long, mark long, first long, data binary"), "wanted")
    scratch.cleared("verdicts")
    at = ["key", "i", "j"]
    dealt_out = in_blocks(found, scratch).repartition(partitions, *at).sortWithinPartitions(*at)
    return dealt_out.mapInArrow(resolved, "id long, mark long, first long, last long")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans (joined spans) and kept_sha256; keep_text adds kept_text and all
    columns of docs.

    Texts are UTF-8 bytes, a null one is empty; nothing goes from texts of under LENGTH bytes. Rows that repeat an id
    don't cover each other; a null id covers nothing and nothing of it goes. Strings are judged on the input. An empty
    table gives an empty result. kept_text drops what no longer is UTF-8 where a cut parts a character. Columns of docs
    named as those made here are replaced with keep_text, and other columns aren't read without it.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = covered_spans(docs, scratch, id_col, text_col).groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    spans = scratch.written(spans, "spans")
    scratch.cleared("wanted", "large")
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    others = [c for c in docs.columns if c not in made] if keep_text else [id_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{id_col}`").cast("long").alias("__id"), F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8").alias("__data")).withColumn("__mark", F.xxhash64("__data"))
    at = ["__id", "__mark"]
    spans = spans.toDF(*at, "__spans")
    both = rows.join(spans, at, "left").select(*[F.col(f"`{c}`") for c in others], "__data", "__spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[: len(others)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in made]
            for x, spans in zip(b.column(len(others)), b.column(len(others) + 1).to_pylist(), strict=True):
                data = memoryview(x.as_buffer())
                s, e = joined(*(np.array([p[k] for p in spans or ()], np.int64) for k in ("first", "last")))
                at, kept = 0, []
                for a, z in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(data[at:a])
                    at = z
                rest = b"".join([*kept, data[at:]])
                for column, value in zip(columns, (len(data), len(data) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text else None), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)][: 4 + keep_text]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *out], names=[*b.schema.names[: len(others)], *made[: 4 + keep_text]])

    return both.mapInArrow(cut, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text)

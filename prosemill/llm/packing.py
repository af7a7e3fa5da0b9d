"""Packing by minimum bin slack: documents' pieces into sequences of a fixed length with no padding.

Each document's ids, with an end id, give whole sequences and one remainder shorter than a sequence. The
remainders of a task wait in a pool. A sequence starts with the longest remainder, and a subset-sum table over
the multiset of waiting lengths, kept as bits of one integer, shows the multiset that fills the rest of the
window closest to its capacity; backtracking through the table gives how many of each length to take. When the
pool is nearly empty, a remainder is cut to close a window's slack, and the last window is cut into lengths that
are powers of two, which need no padding either. Nothing is shuffled and no task needs another's pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 0
#: Remainders that wait at most, and that stay so that later ones find partners.
POOL, KEEP = 4096, 1024
#: Sequence numbers of one task.
TASK_BITS = 36


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """The counts of a sub-multiset of lengths (length -> count) whose sum is closest to capacity from below.

    Bit s of a table row is set if the lengths so far can sum to s. A length's count goes in as powers of two,
    so rows grow with the logarithm of counts. Longer lengths go first; rows stop once capacity is reached.
    """
    mask, rows, items = (1 << (capacity + 1)) - 1, [1], []
    for length in sorted((x for x in lengths if x <= capacity), reverse=True):
        left, step = min(lengths[length], capacity // length), 1
        while left > 0 and not rows[-1] >> capacity & 1:
            take = min(step, left)
            items.append((length, take))
            rows.append((rows[-1] | rows[-1] << (length * take)) & mask)
            left, step = left - take, step * 2
        if rows[-1] >> capacity & 1:
            break
    at, chosen = rows[-1].bit_length() - 1, {}
    for k in range(len(items), 0, -1):
        if not rows[k - 1] >> at & 1:
            length, take = items[k - 1]
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


class Pool:
    """Waiting remainders by length; each is (document, start, ids, the document's number of ids)."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.counts, self.size, self.bits = capacity, {}, {}, 0, 0

    def put(self, item: tuple) -> None:
        n = len(item[2])
        self.by_length.setdefault(n, []).append(item)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.size += 1

    def pop(self, length: int) -> tuple:
        items = self.by_length[length]
        item = items.pop()
        self.size -= 1
        if items:
            self.counts[length] -= 1
        else:
            del self.by_length[length], self.counts[length]
        return item

    def window(self) -> list[tuple]:
        """Takes the longest remainder and those that leave least slack beside it."""
        first = self.pop(max(self.counts))
        rest = self.capacity - len(first[2])
        return [first, *(self.pop(n) for n, k in fill(self.counts, rest).items() for _ in range(k))]


def sequences(documents: Iterator[tuple[object, np.ndarray]], capacity: int) -> Iterator[list[tuple]]:
    """Lists of pieces (document, start, ids, the document's number of ids), each list one sequence."""
    pool = Pool(capacity)
    for doc, ids in documents:
        whole = len(ids) // capacity * capacity
        for start in range(0, whole, capacity):
            yield [(doc, start, ids[start : start + capacity], len(ids))]
        if whole < len(ids):
            pool.put((doc, whole, ids[whole:].copy(), len(ids)))
        if pool.size >= POOL:
            while pool.size > KEEP:
                yield from closed(pool, pool.window())
    while pool.size:
        yield from closed(pool, pool.window())


def closed(pool: Pool, pieces: list[tuple]) -> Iterator[list[tuple]]:
    """One full sequence; slack is closed by cutting a waiting remainder, or the last window into powers of two."""
    slack = pool.capacity - sum(len(p[2]) for p in pieces)
    if slack and pool.size:
        # all that fits was taken, so what waits is longer than the slack
        doc, start, ids, n = pool.pop(min(pool.counts))
        pieces.append((doc, start, ids[:slack], n))
        pool.put((doc, start + slack, ids[slack:], n))
        slack = 0
    if not slack:
        yield pieces
        return
    left = pool.capacity - slack
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        now, room = [], size
        while room:
            doc, start, ids, n = pieces.pop(0)
            now.append((doc, start, ids[:room], n))
            if len(ids) > room:
                pieces.insert(0, (doc, start + room, ids[room:], n))
            room -= len(now[-1][2])
        yield now


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length, ids_crc32, doc_tokens (ids with the
    end id), sequence_id and offset in that sequence; with_ids adds the ids themselves.

    A null or empty text is the end id alone. A repeated row is packed each time; a null id stays null. An empty
    table gives an empty one. Other columns of docs are not read. capacity must be a power of two for the last
    windows to need no padding. Sequence numbers hold the task's number, so a task that runs again on the same
    rows gives the same ones.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = kept.schema[0].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).ids
        number = TaskContext.get().partitionId() << TASK_BITS
        end, types = np.array([end_id], np.uint32), {}

        def documents():
            for b in batches:
                types["id"] = b.column(0).type
                for doc, text in zip(b.column(0), b.column(1), strict=True):
                    yield doc.as_py(), np.concatenate([ids_of(text.as_py() or ""), end])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [types["id"], *[pa.int64()] * 6, *([pa.list_(pa.int64())] * with_ids)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] * with_ids)]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows = []
        for pieces in sequences(documents(), capacity):
            offset = 0
            for doc, start, ids, n in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset, *([ids.tolist()] * with_ids)))
                offset += len(ids)
            number += 1
            if len(rows) >= 8192:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    columns = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return kept.mapInArrow(pack, columns + ", ids array<long>" * with_ids)

"""Token counts of whole texts: batches in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of text that are made Python strings at once.
BATCH_BYTES = 1 << 20


def by_bytes(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The column's strings in batches of about equal UTF-8 bytes: a long text makes a batch of its own. Null is empty."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < len(column):
        before = ends[k - 1] if k else 0
        to = max(k + 1, int(np.searchsorted(ends, before + most, "right")))
        yield [x or "" for x in column.slice(k, to - k).to_pylist()]
        k = to


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null; repeated rows are counted each; an
    empty table gives an empty one. Other columns of docs are not read, whatever their names. There is no
    shuffle: each task encodes the rows that it reads.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(vocabulary).lengths
        for b in batches:
            n_tokens = np.concatenate([np.empty(0, np.int64), *map(lengths, by_bytes(b.column(1)))])
            n_bytes = pc.binary_length(b.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(counts, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

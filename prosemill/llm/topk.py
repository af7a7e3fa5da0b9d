"""Exact top-k search by tiled matrix products.

Queries are dealt to groups of bounded size and all rows to shards. A grid deals each group to each shard; a cell holds
its group's matrix and takes its shard's rows in tiles as they stream by. Each tile is a matrix product, of which only
each query's best rows are kept (partial selection) and merged with the cell's lists so far. The cells' lists are
merged by query as a tree: within parts of a query's lists, then over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x). Queries of a group; shards at least; queries and rows of a tile.
SCALE, GROUP, SHARDS, TILE = 1024, 32768, 24, (1024, 2048)
TOP = 10
#: Sums of whole-number products below this are exact in doubles.
_EXACT = float(1 << 53)


def whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of vectors of dim components, as doubles."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).reshape(-1, dim)


def top(query: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, score, row) triples the k of highest score for each query, ties to smaller rows, in that order."""
    order = np.lexsort((row, -score, query))
    query, score, row = query[order], score[order], row[order]
    place = np.arange(len(query)) - np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))[np.cumsum(np.concatenate([[False], query[1:] != query[:-1]]))] if len(query) else query
    return query[place < k], score[place < k], row[place < k]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles if they can't be rounded there, else in Python's integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in rows]
    found = [[sum(int(a) * b for a, b in zip(q, row, strict=True)) for row in exact] for q in queries]
    return np.array(found, dtype=object).astype(np.int64)  # raises beyond a long


class Cell:
    """The queries of one group and their best rows so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.matrix = k, [], []
        self.best = (np.empty(0, np.int64),) * 3

    def ask(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids.append(ids)
        self.matrix.append(matrix)

    def look(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        if not self.ids or not len(ids):
            return
        if len(self.ids) > 1:
            self.ids, self.matrix = [np.concatenate(self.ids)], [np.concatenate(self.matrix)]
        asked, asking = self.ids[0], self.matrix[0]
        for r in range(0, len(ids), TILE[1]):
            rows, at = matrix[r : r + TILE[1]], ids[r : r + TILE[1]]
            for q in range(0, len(asked), TILE[0]):
                self.tile(q, asked[q : q + TILE[0]], asking[q : q + TILE[0]], at, rows)

    def tile(self, first: int, asked: np.ndarray, asking: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = products(asking, rows)
        others = asked[:, None] != ids[None, :]
        scores = np.where(others, scores, np.iinfo(np.int64).min)
        good = others
        if len(ids) > self.k:  # all that tie with a query's k-th of this tile are looked at
            good = others & (scores >= np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None])
        i, j = np.nonzero(good)
        mine = (self.best[0] >= first) & (self.best[0] < first + len(asked))
        merged = top(*(np.concatenate(x) for x in zip((i + first, scores[i, j], ids[j]), (b[mine] for b in self.best), strict=True)), self.k)
        self.best = tuple(np.concatenate([b[~mine], m]) for b, m in zip(self.best, merged, strict=True))

    def result(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.ids:
            query, score, row = self.best
            yield np.concatenate(self.ids)[query], row, score


def searched(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), the row's id and score: for each row of queries the k rows of highest integer inner
    product with it, ties to smaller ids, fewer if there are fewer; a row with the query's own id doesn't count.

    Vectors null, empty or with null or non-finite components take no part, on either side, nor do null ids. Vectors of
    different lengths aren't compared. Of a repeated query id the least vector asks; a repeated row of rows counts each
    time. An empty table gives an empty result. Other columns aren't read. Scores are longs; one beyond a long's range
    raises an error.
    """
    spark = rows.sparkSession

    def usable(side: DataFrame) -> DataFrame:
        vector = F.col(f"`{vector_col}`")
        fine = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return side.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0) & fine)

    asking = usable(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-asking.count() // GROUP))
    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a query goes to each shard and a row to each group: the grid's cells number groups x shards
    asking = asking.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "id", "vector")
    asked = usable(rows).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "id", "vector")
    key = ["dim", "group", "shard"]
    grid = asking.unionByName(asked).withColumn("dim", F.size("vector")).select(*key, "kind", "id", "vector").repartition(*key).sortWithinPartitions(*key, "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell(k)
        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(4)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1 if b.num_rows else []
            for start, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True) if b.num_rows else ():
                now, kind = tuple(int(x[start]) for x in keys[:3]), keys[3][start]
                if now != at:
                    yield from made(cell)
                    at, cell = now, Cell(k)
                part = b.slice(start, end - start)
                (cell.look if kind else cell.ask)(part.column(4).to_numpy(), whole(part.column(5), now[0]))
        yield from made(cell)

    def made(cell: Cell) -> Iterator[pa.RecordBatch]:
        for columns in cell.result():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", id_col, "score"])

    lists = grid.mapInArrow(search, f"query_id long, `{id_col}` long, score long")
    order = [F.desc("score"), F.asc(f"`{id_col}`")]
    part = F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(16))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", part).orderBy(*order))).where(F.col("rank") <= k)
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), f"`{id_col}`", "score")


#: The same over whole tables in DuckDB.
SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x
    from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
    select q.vec_id as query_id, r.vec_id, cast(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * r.x[i])) as bigint) as score
    from v q join v r on len(q.x) = len(r.x) and q.vec_id <> r.vec_id
    where q.vec_id % 100 = 0
), o as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from o where rank <= 10
"""

"""Blocks of rows with an index each, and queries that stream past them: searches of a stated query set against all rows.

Rows are dealt into blocks by a hash of their id. Each row is shuffled once, into its block, and each query once for every block; a task sorts
its blocks' rows before their queries, builds a block's index once and lets the queries pass it, a batch at a time. So a task holds one block
and one batch, whatever the data, and work is queries times rows, as a search of a given query set against all rows has it.
Only the k best of each query and block leave a task.

Vectors that are null, empty, or hold null or non-finite components take no part, on either side; so do rows without
an id. If lengths differ, a query meets the rows of its own length only. Repeated rows are candidates each, but rows
with the query's own id are not; a repeated query id is searched once for each different vector. Ties go to the smaller id. An empty table
gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: index(ids, matrix) gives search(query_ids, query_matrix), which gives (ids, scores) of the best of each query.
Search = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]
Index = Callable[[np.ndarray, np.ndarray], Search]


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def best_of_blocks(queries: DataFrame, rows: DataFrame, index: Index, k: int, *, score: str, largest: bool, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best by score, ties to the smaller vec_id; `score` is the type."""
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    both = rows.select(own.alias("block"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("no"), "v").unionByName(
        queries.dropDuplicates().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", F.xxhash64("v").alias("no"), "v")
    )
    dealt = both.withColumn("dim", F.size("v")).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "dim", "kind", "vec_id")
    kind_of = pa.int64() if score == "long" else pa.float64()

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, search = None, [], None
        for part in parts:
            keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("block", "dim", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), part.num_rows] if part.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                (block, dim, kind), some = keys[lo].tolist(), part.slice(lo, hi - lo)
                if (block, dim) != at:
                    at, held, search = (block, dim), [], None
                if kind == 0:
                    held.append((some.column("vec_id").to_numpy(), _matrix(some.column("v"))))
                    continue
                if not held and search is None:
                    continue  # no row of the block has this length
                if search is None:
                    search, held = index(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])), []
                ids, numbers = some.column("vec_id").to_numpy(), some.column("no").to_numpy()
                found = search(ids, _matrix(some.column("v")))
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(numbers, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]), kind_of)],
                    ["query_id", "query_no", "vec_id", "score"],
                )

    parts = dealt.mapInArrow(meet, f"query_id long, query_no long, vec_id long, score {score}")
    # k rows of each block and query meet here, not all pairs.
    order = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc() if largest else F.col("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def smallest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        some = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], scores[some]))][:k]

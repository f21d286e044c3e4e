"""Exact top-k inner products by block-at-a-time pruning.

Vectors are scaled to integers and cut, in ranges of vec_id, into blocks. A block keeps a forward index
(its vectors, dense) and each component's largest and smallest value. For a query the sum over
components of the better of weight x largest and weight x smallest bounds every score in the block.
Blocks are taken in descending order of their bounds until the next bound is below the k-th score so far;
ties at the k-th score are still looked at, since a smaller vec_id may win them.

Queries come in chunks of bounded size. A task holds one query chunk and one range of blocks and sends k
rows per query; the final step takes the best k of these per query in rounds of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 256
QUERY_ROWS = 8192
RANGE_ROWS = 4096
EXACT = float(1 << 53)
NONE = -(2**63) + 1


def scaled(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component, or NULL if the vector or a component is NULL or not finite."""
    values = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(values.isNotNull() & finite, F.transform(values, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _dense(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    width = max(int(length.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = column.flatten().to_numpy()
    return out


def _scores(queries: np.ndarray, vectors: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum fits, else in integers."""
    if limit < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class Blocks:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.arange(0, len(ids), rows)
        self.ends = np.minimum(self.starts + rows, len(ids))
        self.high = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.vectors, self.starts, axis=0)

    def bounds(self, queries: np.ndarray, limit: float) -> np.ndarray:
        """Summed term maxima of every query and block."""
        return _scores(np.maximum(queries, 0), self.high, limit) + _scores(np.minimum(queries, 0), self.low, limit)

    def best(self, names: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best (vec_id, score), by descending score and ascending vec_id.

        Queries that want the same block at the same turn share one product with its forward index.
        """
        width = self.vectors.shape[1]
        limit = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * width
        bounds = self.bounds(queries, limit)
        order = np.argsort(-bounds, axis=1, kind="stable")
        sorted_bounds = np.take_along_axis(bounds, order, axis=1)
        top_scores = np.full((len(names), k), NONE)
        top_ids = np.full((len(names), k), np.iinfo(np.int64).max)
        found = np.zeros(len(names), np.int64)
        alive = np.arange(len(names))
        for turn in range(len(self.starts)):
            alive = alive[(found[alive] < k) | (sorted_bounds[alive, turn] >= top_scores[alive, k - 1])]
            if not len(alive):
                break
            wanted = order[alive, turn]
            for block in np.unique(wanted):
                mine = alive[wanted == block]
                rows = slice(self.starts[block], self.ends[block])
                scores = _scores(queries[mine], self.vectors[rows], limit)
                ids = np.broadcast_to(self.ids[rows], scores.shape)
                own = ids == names[mine, None]
                found[mine] += (~own).sum(axis=1)
                # Each side's candidates: those at least as good as its k-th in this block.
                scores = np.concatenate((top_scores[mine], np.where(own, NONE, scores)), axis=1)
                ids = np.concatenate((top_ids[mine], np.where(own, np.iinfo(np.int64).max, ids)), axis=1)
                cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                for row, q in enumerate(mine):
                    keep = np.flatnonzero(scores[row] >= cut[row])
                    keep = keep[np.lexsort((ids[row, keep], -scores[row, keep]))[:k]]
                    top_scores[q], top_ids[q] = scores[row, keep], ids[row, keep]
        for q, name in enumerate(names):
            n = min(int(found[q]), k)
            yield name, top_ids[q, :n], top_scores[q, :n]


def _search(k: int, block_rows: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and vectors.num_rows:
            dense = _dense(vectors.column("v"))
            asked = _dense(queries.column("v"))
            width = max(dense.shape[1], asked.shape[1])
            dense, asked = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (dense, asked))
            blocks = Blocks(vectors.column("vec_id").to_numpy(), dense, block_rows)
            for name, ids, scores in blocks.best(queries.column("query_id").to_numpy(), asked, k):
                out["query_id"].append(np.full(len(ids), name))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        joined = {n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for n, v in out.items()}
        return pa.table(joined)

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, vector: str = "embedding", vec_id: str = "vec_id",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query.

    Scores are inner products of the scaled integer vectors and must fit 64 bits; ties go to the smaller
    vec_id. A query's candidates are all rows but those of its own id. Vectors that are NULL or hold NULL or
    non-finite components, and rows without an id, take no part; missing components of shorter vectors count
    as 0. Repeated rows are candidates each; of queries that share an id the least vector asks. Fewer
    candidates than k give fewer rows; empty tables give none. Other columns are ignored.
    """
    usable = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(vector, scale).alias("v")).dropna()
    rows = usable(vectors)
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    # Cells of a grid: query chunks by hash, vector ranges by id with about equal counts.
    ranges, chunks = max(1, -(-n // range_rows)), max(1, -(-m // query_rows))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    dealt = rows.repartitionByRange(ranges, F.col("vec_id"), F.xxhash64("v"))
    grid_queries = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks))).withColumn("range", every(ranges))
    grid_vectors = dealt.withColumn("range", F.pmod(F.spark_partition_id(), F.lit(ranges)).cast("long")).withColumn("chunk", every(chunks))
    found = (
        grid_queries.groupBy("chunk", "range")
        .cogroup(grid_vectors.groupBy("chunk", "range"))
        .applyInArrow(_search(k, block_rows), "query_id long, vec_id long, score long")
    )
    best = Window.orderBy(F.desc("score"), "vec_id")
    while ranges > 64:
        ranges = -(-ranges // 64)
        part = F.pmod(F.xxhash64("vec_id"), F.lit(ranges))
        found = found.withColumn("part", part)
        found = found.withColumn("rank", F.row_number().over(best.partitionBy("query_id", "part"))).where(F.col("rank") <= k).drop("part", "rank")
    found = found.withColumn("rank", F.row_number().over(best.partitionBy("query_id"))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


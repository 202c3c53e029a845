"""Exact top-k search by branch and bound over columns.

Vectors lie in blocks, one column per dimension. Scores grow by a few dimensions at a time; what the other dimensions
can still add is bounded by the product of the remaining lengths (Cauchy-Schwarz). Candidates whose upper bound is below
the k-th best lower bound are dropped and the columns of the rest are compacted before the next dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resight.session import cut, cut_and_observe

VECTOR_BLOCK = 8192
QUERY_BLOCK = 512
BLOCKS_PER_CELL = 8
DIMENSIONS = 16


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))


def packed_blocks(df: DataFrame, rows: int) -> DataFrame:
    """block rows (ids, columns, dims, n): up to `rows` vectors of a partition, one column after another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block() -> pa.RecordBatch:
            dims = max(map(len, vectors))
            grid = np.zeros((dims, len(vectors)), dtype=np.int64)
            for at, vector in enumerate(vectors):
                grid[: len(vector), at] = vector
            narrow = grid.astype(np.int32)
            kept = narrow if (narrow == grid).all() else grid
            return pa.RecordBatch.from_arrays(
                [pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([kept.tobytes()], pa.binary()),
                 pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int32())], names=["ids", "columns", "dims", "n"])

        for batch in batches:
            ids += batch.column("id").to_pylist()
            vectors += batch.column("vector").to_pylist()
            while len(ids) >= rows:
                rest = ids[rows:], vectors[rows:]
                ids, vectors = ids[:rows], vectors[:rows]
                yield block()
                ids, vectors = rest
        if ids:
            yield block()

    return df.mapInArrow(work, "ids binary, columns binary, dims int, n int")


def open_block(ids: bytes, columns: bytes, dims: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int32 if len(columns) == 4 * dims * n else np.int64
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(columns, dtype=kind).reshape(dims, n)


def best_of_block(
    q_ids: np.ndarray, queries: np.ndarray, v_ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray,
    step: int = DIMENSIONS,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, the places of its candidates that can be among the k best, and their scores.

    `floor` holds a score per query that k candidates are known to reach (or minus infinity).
    """
    dims = min(len(queries), len(vectors))  # missing components count as 0
    largest = [float(np.abs(x[:dims].astype(np.float64)).max(initial=0)) for x in (queries, vectors)]
    if dims * largest[0] * largest[1] >= 2.0**52:  # beyond exact doubles: 64-bit integers, no bounds
        for at in range(len(q_ids)):
            score = (queries[:dims, at].astype(np.int64)[:, None] * vectors[:dims].astype(np.int64)).sum(axis=0)
            yield at, np.nonzero(v_ids != q_ids[at])[0], score[v_ids != q_ids[at]]
        return
    left, right = queries[:dims].astype(np.float64), vectors[:dims].astype(np.float64)
    cuts = list(range(0, dims, step)) + [dims]
    # Lengths of what comes after each cut.
    rest_q = [np.sqrt((left[c:] ** 2).sum(axis=0)) for c in cuts]
    rest_v = [np.sqrt((right[c:] ** 2).sum(axis=0)) for c in cuts]
    first = cuts[1] if len(cuts) > 1 else 0
    whole = left[:first].T @ right[:first]
    for at in range(len(q_ids)):
        alive = np.nonzero(v_ids != q_ids[at])[0]
        score, bar = whole[at, alive], floor[at]
        columns = right
        for turn in range(1, len(cuts)):
            if turn > 1:
                begin, end = cuts[turn - 1], cuts[turn]
                score = score + left[begin:end, at] @ columns[begin:end]
            slack = rest_q[turn][at] * rest_v[turn][alive] * (1 + 1e-9) + (0.5 if turn < len(cuts) - 1 else 0.0)
            if alive.size > k:
                bar = max(bar, np.partition(score - slack, alive.size - k)[alive.size - k])
            keep = score + slack >= bar
            if turn < len(cuts) - 1:
                columns = columns[:, alive[keep]] if columns is right else columns[:, keep]
            alive, score = alive[keep], score[keep]
            if not alive.size:
                break
        yield at, alive, score.astype(np.int64)


def merge_best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(
    df: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` highest inner products of every query with all other rows.

    `queries` is a condition on `df`. Components are floor(scale * x); scores are exact 64-bit integers (larger ones
    wrap). Ties go to the smaller id. Rows without an id, without a vector or with a null or non-finite component take
    no part; a shorter vector counts as filled up with zeros. Rows with the query's own id are not its candidates; a
    repeated candidate row is found as often as it stands; of repeated query ids the smallest vector asks. With fewer
    than `k` candidates all are returned; an empty table gives an empty one; other columns are not read.

    Every block of queries meets every block of vectors as one row of a join on cells, and keeps its `k` best of a cell
    before anything is shuffled again.
    """
    fit = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    slim = fit.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("vector"),
                      F.coalesce(queries, F.lit(False)).alias("asks"))
    blocks, seen = cut_and_observe(
        packed_blocks(slim.select("id", "vector"), VECTOR_BLOCK).withColumn("no", F.monotonically_increasing_id()),
        "vectors", F.count(F.lit(1)).alias("n"))
    asking = slim.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asking, asked = cut_and_observe(asking, "queries", F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-asked["n"] // QUERY_BLOCK))
    cells = max(-(-seen["n"] // BLOCKS_PER_CELL), min(seen["n"], 64), 1)
    asking = packed_blocks(asking.repartition(parts, "id"), QUERY_BLOCK).select(
        F.struct("ids", "columns", "dims", "n").alias("q"), F.monotonically_increasing_id().alias("q_no"))
    asking = cut(asking, "asking").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    blocks = blocks.select(F.struct("ids", "columns", "dims", "n").alias("v"),
                           F.pmod(F.xxhash64("no"), F.lit(cells)).cast("int").alias("cell"))
    met = asking.join(blocks.hint("merge"), "cell").select("q_no", "q", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, q_ids, best = None, None, []

        def give() -> pa.RecordBatch:
            counts = [len(ids) for ids, _ in best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, counts), pa.int64()), pa.array(np.concatenate([i for i, _ in best]), pa.int64()),
                 pa.array(np.concatenate([s for _, s in best]), pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                no, q, v = (batch.column(c)[row].as_py() for c in ("q_no", "q", "v"))
                if no != held:
                    if held is not None:
                        yield give()
                    held, (q_ids, asked) = no, open_block(**q)
                    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
                v_ids, vectors = open_block(**v)
                floor = np.array([s[-1] if len(s) == k else -np.inf for _, s in best])
                for at, alive, score in best_of_block(q_ids, asked, v_ids, vectors, k, floor):
                    ids, scores = best[at]
                    best[at] = merge_best(np.concatenate([ids, v_ids[alive]]), np.concatenate([scores, score]), k)
        if held is not None:
            yield give()

    found = met.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""k-nearest-neighbour joins between two vector tables.

Input: queries(query_id, scale, vec_id, vec) and database(scale, vec_id, vec, target). Output:
the `count` nearest database vectors of every query vector, ties broken by the smaller id:
(query_id, scale, q_vec, d_vec, target, dist).

Exact search follows pivot partitioning (Lu et al., VLDB 2012). Every database vector belongs
to its nearest pivot. A query has at least `count` neighbours within the distance to its
count-th nearest pivot, so cells that lie wholly beyond that distance are skipped. The pivots
and their cell radii are a parameter-bounded table (beyond the bound: `stored_index`).

Cells that lie near each other make up a part, and a scale has few parts, so a query is copied a
bounded number of times however many cells it has to look into. Inside a part the cells are
skipped one by one, and a query leaves the part with its `count` best only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resight.operators import blocks
from resight.params import NeighbourParams
from resight.session import scratch_path

RESULT = ["query_id", "scale", "q_vec", "d_vec", "target", "dist"]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0)


def _upper_bound(rough: np.ndarray, count: int, folds: int = 16) -> np.ndarray:
    """Per row a value that at least `count` entries do not exceed.

    Columns are folded onto each other by minimum first: the count-th smallest of the folded
    row belongs to count different columns, and only a narrow matrix has to be partitioned.
    """
    width = rough.shape[1] // folds
    if width < 2 * count:
        return np.partition(rough, count - 1, axis=1)[:, count - 1]
    folded = rough[:, :width].copy()
    for k in range(1, folds):
        np.minimum(folded, rough[:, k * width:(k + 1) * width], out=folded)
    return np.partition(folded, count - 1, axis=1)[:, count - 1]


def nearest_in_block(
    queries: np.ndarray, items: np.ndarray, ids: np.ndarray, count: int, width: int = 1024, within: np.ndarray | None = None
):
    """(query row, item row, distance) of the `count` nearest items by (distance, id); with `within` none need be farther.

    Items are taken `width` at a time. A single-precision matrix product (squared distance less
    the query's own square) makes a shortlist against the best bound so far, widened by the
    rounding error such a product can have; the shortlist is measured again in double precision
    by plain differences, so equal vectors are at equal distance in every block.
    """
    own, squares = (queries * queries).sum(axis=1), (items * items).sum(axis=1)
    # Values whose squares single precision cannot hold are multiplied in double precision.
    kind = np.float32 if max(own.max(initial=0.0), squares.max(initial=0.0)) < 1e30 else np.float64
    slack = 4.0 * (queries.shape[1] + 4) * np.finfo(kind).eps * (own + squares.max(initial=0.0)) + 1e-30
    rounded = queries.astype(kind)
    bound = np.full(len(queries), np.inf) if within is None else within * within * (1 + 1e-9) - own
    rows, cols, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for low in range(0, len(items), width):
        part = (-2.0 * items[low:low + width].T).astype(kind)
        rough = rounded @ part
        rough += squares[low:low + width].astype(kind)
        if part.shape[1] >= count:
            bound = np.minimum(bound, _upper_bound(rough, count))
        row, col = np.divmod(np.flatnonzero(rough <= (bound + slack).astype(kind)[:, None]), part.shape[1])
        col += low
        near = _distances(queries, items, row, col)
        rows, cols, dist = _first_of_each(
            np.concatenate([rows, row]), np.concatenate([cols, col]), np.concatenate([dist, near]), ids, count)
    return rows, cols, dist


def _distances(queries: np.ndarray, items: np.ndarray, row: np.ndarray, col: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Distances of pairs, `step` pairs at a time: near-copies can put every pair on the shortlist."""
    out = np.empty(len(row))
    for at in range(0, len(row), step):
        diff = queries[row[at:at + step]] - items[col[at:at + step]]
        out[at:at + step] = np.sqrt((diff * diff).sum(axis=1))
    return out


def _first_of_each(rows: np.ndarray, cols: np.ndarray, dist: np.ndarray, ids: np.ndarray, count: int):
    """The `count` first pairs of each row by (distance, id)."""
    order = np.lexsort((ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < count
    return rows[keep], cols[keep], dist[keep]


def _block_neighbours(batches, schema: pa.Schema, count: int):
    for batch in batches:
        found = []
        for r in range(batch.num_rows):
            q, d = batch.column("_q")[r].values, batch.column("_d")[r].values
            # Ids of any kind, by their order.
            ids = np.unique(d.field("d_vec").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            rows, cols, dist = nearest_in_block(_matrix(q.field("vec")), _matrix(d.field("vec")), ids, count)
            rows, cols = pa.array(rows), pa.array(cols)
            scale = batch.column("scale").take(pa.array([r] * len(rows), pa.int64()))
            out = [q.field("query_id").take(rows), scale, q.field("q_vec").take(rows), d.field("d_vec").take(cols),
                   d.field("target").take(cols), pa.array(dist)]
            found.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema))
        yield from pa.Table.from_batches(found, schema).combine_chunks().to_batches()


def _result_schema(queries: DataFrame, database: DataFrame) -> T.StructType:
    kinds = {
        "query_id": queries.schema["query_id"].dataType, "scale": queries.schema["scale"].dataType,
        "q_vec": queries.schema["q_vec"].dataType, "d_vec": database.schema["d_vec"].dataType,
        "target": database.schema["target"].dataType, "dist": T.DoubleType(),
    }
    return T.StructType([T.StructField(n, kinds[n]) for n in RESULT])


def _renamed(queries: DataFrame, database: DataFrame) -> tuple[DataFrame, DataFrame]:
    vec = F.col("vec").cast("array<double>").alias("vec")
    q = queries.select("query_id", "scale", F.col("vec_id").alias("q_vec"), vec)
    d = database.select("scale", F.col("vec_id").alias("d_vec"), vec, "target")
    return q, d


def fold_copies(d: DataFrame, count: int) -> DataFrame:
    """Keep the `count` smallest ids of each set of equal vectors.

    Equal vectors are at equal distance from everything, so no further copy can be among the
    `count` nearest. A collection in which one vector fills a third of the rows is thereby
    reduced, map-side first, before any distances are taken.
    """
    copies = W.partitionBy("scale", "_hash", "vec").orderBy("d_vec")
    hashed = d.withColumn("_hash", F.xxhash64("vec"))
    return hashed.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= count).drop("_copy", "_hash")


def keep_nearest(found: DataFrame, count: int) -> DataFrame:
    """Merge the winners of all blocks; Spark limits each group before the shuffle."""
    best = W.partitionBy("query_id", "scale", "q_vec").orderBy("dist", "d_vec")
    return found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= count).drop("_place")


def _join_blocks(q: DataFrame, d: DataFrame, keys: list[str], count: int, params: NeighbourParams) -> DataFrame:
    large_q = blocks.large_keys(q, keys, params.block_rows)
    large_d = blocks.large_keys(d, keys, params.db_block_rows)
    q_blocks = blocks.pack(q, keys, "q_vec", ["query_id", "q_vec", "vec"], params.block_rows, large_q)
    d_blocks = blocks.pack(d, keys, "d_vec", ["d_vec", "target", "vec"], params.db_block_rows, large_d)
    met = blocks.meet(
        q_blocks.withColumnRenamed("_items", "_q"), d_blocks.withColumnRenamed("_items", "_d"),
        keys, large_q, large_d, params.blocks_per_salt,
    )
    spark_schema = _result_schema(q, d)
    schema = to_arrow_schema(spark_schema)
    return met.select("scale", "_q", "_d").mapInArrow(lambda b: _block_neighbours(b, schema, count), spark_schema)


def _parts(n: int, params: NeighbourParams) -> int:
    """Parts of a scale of n database rows."""
    return max(1, min(-(-n // params.part_rows), max(params.max_parts, -(-n // params.full_part))))


def _by_rank(ids: pa.Array) -> np.ndarray:
    """The place of every id in their order."""
    order = pc.array_sort_indices(ids).to_numpy()
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return places


class _Asked:
    """The queries of one block in one part, and what they have found so far."""

    def __init__(self, q: pa.StructArray, count: int, pivots: "Pivots | None", scale: str):
        self.q, self.vec, self.count = q, _matrix(q.field("vec")), count
        self.within = np.full(len(q), np.inf)
        self.rows, self.dist, self.ids, self.targets = np.empty(0, np.int64), np.empty(0), None, None
        self.near = self.far = None
        if pivots is not None:
            self.far = np.sqrt(_squared(self.vec, pivots.vectors[scale])) - pivots.radii[scale][None, :]
            self.near = pivots.candidates(scale, self.vec, count)

    def runs(self, d: pa.StructArray, vec: np.ndarray) -> list[tuple[slice | np.ndarray, np.ndarray]]:
        """Queries and rows of the block that have to meet."""
        if self.near is None:
            return [(slice(None), np.arange(len(d)))]
        cells = d.field("cell").to_numpy()
        order = np.argsort(cells, kind="stable")
        starts = np.flatnonzero(np.diff(cells[order], prepend=-1))
        runs = []
        for at, rows in zip(cells[order][starts], np.split(order, starts[1:])):
            asked = np.flatnonzero(self.near[:, at] & (self.far[:, at] <= self.within + 1e-6))
            if len(asked):
                runs.append((asked, rows))
        return runs

    def meet(self, d: pa.StructArray) -> None:
        ids, vec, places = d.field("d_vec"), _matrix(d.field("vec")), _by_rank(d.field("d_vec"))
        runs = self.runs(d, vec)
        found = []
        for asked, rows in runs:
            row, col, dist = nearest_in_block(self.vec[asked], vec[rows], places[rows], self.count, within=self.within[asked])
            found.append((row if isinstance(asked, slice) else asked[row], rows[col], dist))
        if not found:
            return
        rows, cols, dist = (np.concatenate(c) for c in zip(*found))
        taken = pa.array(cols)
        ids, targets = ids.take(taken), d.field("target").take(taken)
        if self.ids is not None:
            rows, dist = np.concatenate([self.rows, rows]), np.concatenate([self.dist, dist])
            ids, targets = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.targets, targets])
        self.rows, kept, self.dist = _first_of_each(rows, np.arange(len(rows)), dist, _by_rank(ids), self.count)
        self.ids, self.targets = ids.take(pa.array(kept)), targets.take(pa.array(kept))
        number = np.bincount(self.rows, minlength=len(self.within))
        last = np.cumsum(number) - 1
        full = number >= self.count
        self.within[full] = self.dist[last[full]]

    def found(self, scale: pa.Scalar, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.ids is None:
            return
        rows = pa.array(self.rows)
        out = [self.q.field("query_id").take(rows), pa.array([scale] * len(rows), scale.type), self.q.field("q_vec").take(rows),
               self.ids, self.targets, pa.array(self.dist)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)


def _part_neighbours(batches, schema: pa.Schema, count: int, pivots: "Pivots | None"):
    """The best of every query block over all the database blocks that follow each other beside it."""
    asked = known = scale = None
    for batch in batches:
        for r in range(batch.num_rows):
            key = tuple(batch.column(c)[r].as_py() for c in ("_name", "_part", "_qb"))
            if key != known:
                if asked is not None:
                    yield from asked.found(scale, schema)
                known, scale = key, batch.column("scale")[r]
                asked = _Asked(batch.column("_q")[r].values, count, pivots, key[0])
            asked.meet(batch.column("_d")[r].values)
    if asked is not None:
        yield from asked.found(scale, schema)


def _meet_parts(
    q: DataFrame, d: DataFrame, block: Column, hand: Column, hands: Column, count: int, result: T.StructType, pivots: "Pivots | None"
) -> DataFrame:
    """Queries (…, _name, _part) beside the database rows (…, _name, _part, _block) of their part, reduced block by block.

    Keys are (scale, part, hand): a query has one `hand`, a database row is copied to all. Either side is shuffled once, into an
    explicit number of tasks, as rows are few but expensive. Blocks of one hand stay in its task.
    """
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_name", "_part", "_hand"]
    members = ["d_vec", "target", "vec", *(["cell"] if "cell" in d.columns else [])]
    schema = to_arrow_schema(result)
    asked = q.withColumns({"_qb": block, "_hand": hand}).repartition(tasks, *keys).groupBy(*keys, "_qb", "scale").agg(
        F.collect_list(F.struct("query_id", "q_vec", "vec")).alias("_q"))
    copies = d.withColumn("_hand", F.explode(F.sequence(F.lit(0).cast("bigint"), hands - 1)))
    held = copies.repartition(tasks, *keys).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*members)).alias("_d"))
    # The left side is streamed: the database blocks of a query block follow each other.
    met = asked.hint("merge").join(held, keys).select("_name", "_part", "_qb", "scale", "_q", "_d")
    return met.mapInArrow(lambda b: _part_neighbours(b, schema, count, pivots), result)


def _blocks_of(params: NeighbourParams) -> tuple[int, int]:
    """Queries and database rows that travel together: small blocks go several at a time."""
    return max(params.block_rows, 2048), max(params.db_block_rows, 8192)


def _hands(n: Column, params: NeighbourParams) -> Column:
    return F.least(F.lit(params.max_hands), F.ceil(n / F.lit(params.part_rows))).cast("bigint")


def blocked_neighbours(
    queries: DataFrame, database: DataFrame, count: int, params: NeighbourParams = NeighbourParams()
) -> DataFrame:
    """Exact search without pruning: every query of a scale meets every part of it."""
    q, d = _renamed(queries, database)
    result, kind = _result_schema(q, d), d.schema["scale"].dataType
    some, many = _blocks_of(params)
    sizes = [side.groupBy("scale").agg(F.count(F.lit(1)).alias(n)) for side, n in ((q, "_nq"), (d, "_nd"))]
    size = sizes[0].join(sizes[1], "scale")
    rows = F.lit(params.part_rows)
    parts = F.least(F.ceil(F.col("_nd") / rows), F.greatest(F.lit(params.max_parts), F.ceil(F.col("_nd") / F.lit(params.full_part))))
    size = size.select("scale", parts.cast("bigint").alias("_parts"), _hands(F.col("_nq"), params).alias("_hands"),
                       F.ceil(F.col("_nq") / F.lit(some)).cast("bigint").alias("_qbs"),
                       F.ceil(F.col("_nd") / parts / F.lit(many)).cast("bigint").alias("_blocks"))
    asked = _with_name(q.join(size, "scale"), kind).withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    block = F.pmod(F.xxhash64("query_id", "q_vec"), F.col("_qbs"))
    held = _with_name(fold_copies(d, count).join(size, "scale"), kind).withColumns({
        "_part": F.pmod(F.xxhash64("d_vec"), F.col("_parts")),
        "_block": F.pmod(F.xxhash64("d_vec", F.lit(1)), F.col("_blocks"))})
    found = _meet_parts(asked, held, block, F.pmod(F.col("_qb"), F.col("_hands")), F.col("_hands"), count, result, None)
    return keep_nearest(found, count)


class Pivots:
    """Pivot vectors per scale and, once measured, the radius of each cell."""

    def __init__(self, vectors: dict[str, np.ndarray], radii: dict[str, np.ndarray] | None = None):
        self.vectors = vectors
        self.radii = radii or {}

    def cells(self, scale: str, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rough = np.sqrt(_squared(vec, self.vectors[scale]))
        cell = rough.argmin(axis=1)
        return cell, rough[np.arange(len(cell)), cell]

    def candidates(self, scale: str, vec: np.ndarray, count: int) -> np.ndarray:
        """Boolean (query, cell): may the cell hold one of the `count` nearest?"""
        radius = self.radii[scale]
        dist = np.sqrt(_squared(vec, self.vectors[scale]))
        if dist.shape[1] >= count:
            bound = np.partition(dist, count - 1, axis=1)[:, count - 1][:, None]
        else:
            bound = np.full((len(vec), 1), np.inf)
        slack = 1e-6
        near = dist - radius[None, :] <= bound + slack
        # A member of a foreign cell is at least half the lead of the home pivot away.
        near &= (dist - dist.min(axis=1)[:, None]) / 2.0 <= bound + slack
        return near & (radius >= 0)[None, :]


def pivots_wanted(d: DataFrame, params: NeighbourParams) -> dict[str, tuple[int, int]] | None:
    """Per scale: number of vectors and of pivots that leave a few full blocks per cell; None beyond `max_pivot_cells` pivots.

    Only the scale column is read.
    """
    counted = d.groupBy(F.col("scale").cast("string").alias("scale")).count().limit(params.max_pivot_cells + 1).collect()
    wanted = {r["scale"]: (r["count"], min(params.pivots, max(1, r["count"] // (2 * params.block_rows)))) for r in counted}
    return wanted if sum(number for _, number in wanted.values()) <= params.max_pivot_cells else None


def choose_pivots(d: DataFrame, params: NeighbourParams, wanted: dict[str, tuple[int, int]]) -> Pivots:
    """The wanted number of database vectors per scale that come first in hash order.

    A hash threshold thins each scale to a few times the number of pivots before anything is
    sorted; at most `max_pivot_cells` rows reach the driver.
    """
    span = 1 << 40
    draw = F.pmod(F.xxhash64("d_vec", F.lit(params.seed)), F.lit(span))
    limits = F.create_map(*[
        F.lit(v) for scale, (rows, number) in wanted.items()
        for v in (scale, span if rows <= 64 * number else int(span * 16 * number / rows))
    ])
    numbers = F.create_map(*[F.lit(v) for scale, (_, number) in wanted.items() for v in (scale, number)])
    named = d.select(F.col("scale").cast("string").alias("scale"), "vec", "d_vec", draw.alias("_draw"))
    first = W.partitionBy("scale").orderBy("_draw", "d_vec")

    def pick(rows: DataFrame) -> pd.DataFrame:
        placed = rows.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= params.pivots)
        return placed.filter(F.col("_place") <= numbers[F.col("scale")]).select("scale", "vec").toPandas()

    picked = pick(named.filter(F.col("_draw") < limits[F.col("scale")])) if wanted else pick(named.limit(0))
    missed = wanted.keys() - set(picked["scale"])
    if missed:  # no row of these scales is below the threshold
        picked = pd.concat([picked, pick(named.filter(F.col("scale").isin(*missed)))])
    return Pivots({s: np.stack(g["vec"].to_numpy()) for s, g in picked.groupby("scale")})


def _with_name(vectors: DataFrame, kind: T.DataType) -> DataFrame:
    """The scale's name beside it, as Spark writes it: other writers of numbers have other forms."""
    return vectors.withColumn("_name", F.col("scale").cast(kind).cast("string"))


def _by_scale(batch: pa.RecordBatch):
    names = batch.column("_name").to_pandas()
    for scale, rows in names.groupby(names).indices.items():
        yield scale, pa.array(rows)


class Layout:
    """Where the rows of a scale's cells lie in its parts: near cells follow each other, a large cell runs through several parts."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, asked: int, params: NeighbourParams):
        n, (some, self.block_rows) = max(int(sizes.sum()), 1), _blocks_of(params)
        centred = vectors - vectors.mean(axis=0)
        order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
        self.sizes, self.starts = np.maximum(sizes, 1), np.empty(len(sizes), np.int64)
        self.starts[order] = np.cumsum(sizes[order]) - sizes[order]
        parts = _parts(n, params)
        self.part_rows = -(-n // parts)
        first, last = self.starts // self.part_rows, (self.starts + self.sizes - 1) // self.part_rows
        at = np.arange(parts)[None, :]
        # (cell, part): does the part hold rows of the cell?
        self.holds = ((first[:, None] <= at) & (at <= last[:, None]) & (sizes > 0)[:, None]).astype(np.float32)
        self.query_blocks = max(1, -(-asked // some))
        self.hands = max(1, min(params.max_hands, -(-asked // params.part_rows)))

    def places(self, cell: np.ndarray, draw: np.ndarray) -> np.ndarray:
        return self.starts[cell] + draw % self.sizes[cell]


def _assign(batches, schema: pa.Schema, pivots: Pivots, layouts: dict[str, Layout]):
    """Database rows with their cell and its distance, or once there are layouts with part, block and number of hands."""
    for batch in batches:
        for scale, rows in _by_scale(batch):
            part = batch.take(rows)
            cell, far = pivots.cells(scale, _matrix(part.column("vec")))
            out = {**{n: part.column(n) for n in part.schema.names}, "cell": pa.array(cell, pa.int32()),
                   "far": pa.array(far)}
            if layouts:
                layout = layouts[scale]
                place = layout.places(cell, part.column("_draw").to_numpy())
                out |= {"_part": pa.array(place // layout.part_rows), "_block": pa.array(place // layout.block_rows),
                        "_hands": pa.array(np.full(len(cell), layout.hands))}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)


def _fan_out(batches, schema: pa.Schema, pivots: Pivots, count: int, layouts: dict[str, Layout]):
    """A copy of every query for each part that holds a cell it has to look into."""
    for batch in batches:
        for scale, rows in _by_scale(batch):
            if scale not in pivots.vectors:
                continue
            layout = layouts[scale]
            for low in range(0, len(rows), 2048):
                some = batch.take(rows[low:low + 2048])
                near = pivots.candidates(scale, _matrix(some.column("vec")), count).astype(np.float32)
                q, part = np.nonzero(near @ layout.holds)
                copies = some.take(pa.array(q))
                block = copies.column("_draw").to_numpy() % layout.query_blocks
                out = {**{n: copies.column(n) for n in copies.schema.names}, "_part": pa.array(part),
                       "_qb": pa.array(block), "_hand": pa.array(block % layout.hands)}
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)


def exact_neighbours(
    queries: DataFrame, database: DataFrame, count: int, params: NeighbourParams = NeighbourParams()
) -> DataFrame:
    """Exact search that skips the cells which cannot hold a neighbour.

    Every collection takes this path, however small; a scale of few vectors has one cell. Where all scales together want more
    than `max_pivot_cells` pivots, the cells come from an index in the shared folder, whose pivots stay in tables: same rows.
    """
    q, d = _renamed(queries, database)
    wanted = pivots_wanted(d, params)
    if wanted is None:
        from resight.operators.stored_index import stored_neighbours, write_index

        return stored_neighbours(queries, write_index(database, scratch_path(d.sparkSession, "index"), params), count, params)
    pivots = choose_pivots(d, params, wanted)
    kind, result, long = d.schema["scale"].dataType, _result_schema(q, d), T.LongType()
    draw = lambda *ids: F.pmod(F.xxhash64(*ids), F.lit(1 << 40))
    name = T.StructField("_name", T.StringType())
    cells = T.StructType([*d.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    arrow_c = to_arrow_schema(cells)
    placed = _with_name(d, kind).mapInArrow(lambda b: _assign(b, arrow_c, pivots, {}), cells)
    # One row per (scale, pivot): bounded by the check above.
    reach = placed.groupBy(F.col("scale").cast("string").alias("scale"), "cell").agg(
        F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).toPandas()
    radii = {s: np.full(len(v), -1.0) for s, v in pivots.vectors.items()}
    sizes = {s: np.zeros(len(v), np.int64) for s, v in pivots.vectors.items()}
    for row in reach.itertuples(index=False):
        radii[row.scale][row.cell], sizes[row.scale][row.cell] = row.r, row.n
    measured = Pivots(pivots.vectors, radii)
    held = d.sparkSession.createDataFrame([(s,) for s in pivots.vectors], "scale string")
    number = q.groupBy(F.col("scale").cast(kind).cast("string").alias("scale")).count().join(held, "scale").toPandas()
    asked_of = dict(zip(number["scale"], number["count"]))
    layouts = {s: Layout(v, sizes[s], int(asked_of.get(s, 0)), params) for s, v in pivots.vectors.items()}
    fanned = T.StructType([*q.schema.fields, name, *(T.StructField(n, long) for n in ("_part", "_qb", "_hand"))])
    arrow_q = to_arrow_schema(fanned)
    asked = _with_name(q, kind).withColumn("_draw", draw("query_id", "q_vec")).mapInArrow(
        lambda b: _fan_out(b, arrow_q, measured, count, layouts), fanned)
    laid = T.StructType([*d.schema.fields, name, T.StructField("cell", T.IntegerType()),
                         *(T.StructField(n, long) for n in ("_part", "_block", "_hands"))])
    arrow_d = to_arrow_schema(laid)
    rows = _with_name(fold_copies(d, count), kind).withColumn("_draw", draw("d_vec")).mapInArrow(
        lambda b: _assign(b, arrow_d, pivots, layouts), laid)
    found = _meet_parts(asked, rows, F.col("_qb"), F.col("_hand"), F.col("_hands"), count, result, measured)
    return keep_nearest(found, count)


def lsh_bits(rows: int, params: NeighbourParams) -> int:
    """Hyperplanes per table so that a bucket holds about `lsh_leaf` vectors."""
    wanted = math.ceil(math.log2(max(rows, 1) / params.lsh_leaf)) if rows > params.lsh_leaf else 1
    return max(1, min(params.lsh_max_bits, wanted))


def _bucket_codes(batches, schema: pa.Schema, tables: int, bits: int, seed: int):
    for batch in batches:
        if batch.num_rows == 0:
            continue
        vec = _matrix(batch.column("vec"))
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(tables, bits, vec.shape[1]))
        codes = (np.einsum("nd,tbd->ntb", vec, planes) >= 0) @ (1 << np.arange(bits))
        rows = pa.array(np.repeat(np.arange(batch.num_rows), tables))
        copies = batch.take(rows)
        out = {**{n: copies.column(n) for n in copies.schema.names},
               "table_no": pa.array(np.tile(np.arange(tables), batch.num_rows), pa.int32()),
               "bucket": pa.array(codes.reshape(-1).astype(np.int64))}
        yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)


def bucketed(df: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Rows copied once per table with their bucket (signs of random hyperplanes)."""
    fields = [*df.schema.fields, T.StructField("table_no", T.IntegerType()), T.StructField("bucket", T.LongType())]
    spark_schema = T.StructType(fields)
    schema = to_arrow_schema(spark_schema)
    return df.mapInArrow(lambda b: _bucket_codes(b, schema, tables, bits, seed), spark_schema)


def lsh_neighbours(
    queries: DataFrame, database: DataFrame, count: int, params: NeighbourParams = NeighbourParams(),
    bits: int | None = None,
) -> DataFrame:
    """Approximate search: vectors that share a bucket in one of the tables are measured exactly."""
    q, d = _renamed(queries, database)
    if bits is None:
        biggest = d.groupBy("scale").count().agg(F.max("count")).first()[0] or 1
        bits = lsh_bits(int(biggest), params)
    tables, seed = params.lsh_tables, params.seed
    keys = ["scale", "table_no", "bucket"]
    database_side = bucketed(fold_copies(d, count), bits, tables, seed)
    found = _join_blocks(bucketed(q, bits, tables, seed), database_side, keys, count, params)
    once = found.dropDuplicates(["query_id", "scale", "q_vec", "d_vec"])
    return keep_nearest(once, count)


METHODS = {"exact": exact_neighbours, "blocked": blocked_neighbours, "lsh": lsh_neighbours}


def neighbours(
    queries: DataFrame, database: DataFrame, count: int, method: str = "exact",
    params: NeighbourParams = NeighbourParams(),
) -> DataFrame:
    if method == "forest":
        from resight.operators.forest import forest_neighbours

        return forest_neighbours(queries, database, count, params)
    return METHODS[method](queries, database, count, params)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found, per scale."""
    keys = ["query_id", "scale", "q_vec", "d_vec"]
    hits = truth.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left")
    return hits.groupBy("scale").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))



"""Exact nearest neighbours from a stored index.

Rows of an index lie in cells around pivots, and cells around heads, which are pivots too. All three levels are tables:
heads(lead, scale, _centres), cells(head, _centres) and blocks(cell_part, lead, cell, salt, block, scale, stretch, _items).
Heads and cells keep the least and the largest distance of their members, so a search needs no pivot on the driver,
whatever the number of scales or rows.

Heads that lie near each other follow one another, and the row of cells is cut into parts, by whose number and `lead` (the
least head of the scale) blocks are bucketed. A scale has at most `max_parts` parts until one would hold more than
`full_part` rows, so a search copies a query to few parts, however many cells are in reach, and never shuffles the database.
Inside a part cells are skipped one by one, and a query leaves it with its `count` best only.

There is about one pivot per 2 * `block_rows` rows and one head per root of the pivots. A scale keeps at most
`db_block_rows` heads and a head as many cells: further pivots are not used, which makes cells larger and loses no row.
Cells of more than `blocks_per_salt` blocks are spread over salts, which may lie in several parts.

Vectors that are null or have no scale are not indexed and find nothing. Ties go to the smaller id. A query of a scale that is
not stored has no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resight.operators import blocks
from resight.operators.neighbours import _Asked, _blocks_of, _matrix, _renamed, _result_schema, _squared, keep_nearest
from resight.params import NeighbourParams
from resight.session import cut, discard

KEYS = ["query_id", "scale", "q_vec"]
PART = ["cell_part", "lead"]
STEP = 1024


@dataclass(frozen=True)
class StoredIndex:
    heads: DataFrame
    cells: DataFrame
    blocks: DataFrame
    #: Buckets of the blocks.
    buckets: int


def _bunch(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, _items): the rows of one key in one Arrow batch, without a shuffle."""
    items = T.StructType([f for f in df.schema if f.name != key])
    out = T.StructType([df.schema[key], T.StructField("_items", T.ArrayType(items))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(key).dictionary_encode()
            codes = coded.indices.to_numpy()
            rows = batch.take(pa.array(np.argsort(codes, kind="stable")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
            kind = schema.field("_items").type
            inner = pa.StructArray.from_arrays(
                [rows.column(f.name).cast(f.type) for f in kind.value_type], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner).cast(kind)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(schema.field(key).type), lists], schema=schema)

    return df.select(key, *items.names).mapInArrow(run, out)


def _beside(met: DataFrame, key: str, added: list[T.StructField], choose: Callable) -> DataFrame:
    """Rows of `_items` with columns of the centres that `choose(vectors, items, centres)` names for them.

    `choose` gives (item numbers, {column: values}); it sees `STEP` items at a time.
    """
    items = met.schema["_items"].dataType.elementType
    out = T.StructType([*items.fields, *([] if key in items.names else [met.schema[key]]), *added])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                every, centres = batch.column("_items")[r].values, batch.column("_centres")[r].values
                points = _matrix(centres.field("vec"))
                for low in range(0, len(every), STEP):
                    part = every.slice(low, STEP)
                    part = pa.StructArray.from_arrays(part.flatten(), fields=list(part.type))
                    rows, columns = choose(np.sqrt(_squared(_matrix(part.field("vec")), points)), part, centres, points)
                    for at in range(0, len(rows), 8 * STEP):
                        mine = pa.array(rows[at:at + 8 * STEP])
                        got = {f.name: part.field(f.name).take(mine) for f in part.type}
                        got.setdefault(key, batch.column(key).take(pa.array([r] * len(mine), pa.int64())))
                        got |= {n: v[at:at + 8 * STEP] for n, v in columns.items()}
                        yield pa.RecordBatch.from_arrays(
                            [(v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for f in schema for v in [got[f.name]]],
                            schema=schema)

    return met.select(key, "_items", "_centres").mapInArrow(run, out)


def _nearest(met: DataFrame, key: str, centre: str, far: str | None = None) -> DataFrame:
    """Every item with its nearest centre."""
    def choose(dist, items, centres, points):
        best = dist.argmin(axis=1)
        found = {centre: centres.field("id").take(pa.array(best))}
        if far:
            found[far] = dist[np.arange(len(best)), best]
        return np.arange(len(best)), found

    added = [T.StructField(centre, T.LongType()), *([T.StructField(far, T.DoubleType())] if far else [])]
    return _beside(met, key, added, choose)


def _slack(vec: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances by products err by up to about 1e-8 of the length of the vectors."""
    length = np.sqrt((vec * vec).sum(axis=1)) + np.sqrt((points * points).sum(axis=1)).max(initial=0.0)
    return 1e-6 * (1.0 + length)


def _bounded(met: DataFrame, key: str, count: int) -> DataFrame:
    """Every item with a distance within which there are `count` stored vectors: pivots, or all members of the nearest cells."""
    def choose(dist, items, centres, points):
        high, n = (centres.field(f).to_numpy(zero_copy_only=False) for f in ("high", "n"))
        ends = dist + high[None, :]
        order = np.argsort(ends, axis=1)
        enough = np.cumsum(n[order], axis=1) >= count
        rows, first = np.arange(len(dist)), enough.argmax(axis=1)
        bound = np.where(enough[rows, first], ends[rows, order[rows, first]], np.inf)
        if dist.shape[1] >= count:
            bound = np.fmin(bound, np.partition(dist, count - 1, axis=1)[:, count - 1])
        bound = np.where(np.isnan(bound), np.inf, bound) + _slack(_matrix(items.field("vec")), points)
        return rows, {"bound": bound}

    return _beside(met, key, [T.StructField("bound", T.DoubleType())], choose)


def _in_reach(met: DataFrame, key: str) -> DataFrame:
    """Every item beside each part that holds a head whose members may lie within the item's bound."""
    def choose(dist, items, centres, points):
        low, high, first, last = (centres.field(n).to_numpy(zero_copy_only=False) for n in ("low", "high", "first", "last"))
        bound = (items.field("bound").to_numpy(zero_copy_only=False) + _slack(_matrix(items.field("vec")), points))[:, None]
        near = (dist - high[None, :] <= bound) & (low[None, :] - dist <= bound)
        at = np.arange(last.max() + 1)[None, :]
        holds = (first[:, None] <= at) & (at <= last[:, None])
        rows, part = np.nonzero(near.astype(np.float32) @ holds.astype(np.float32))
        return rows, {"cell_part": part}

    return _beside(met, key, [T.StructField("cell_part", T.LongType())], choose)


def _turns(heads: DataFrame) -> DataFrame:
    """(lead, head, turn): heads of a scale in the order of their places along the direction in which they differ most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lead, centres in zip(batch.column("lead"), batch.column("_centres")):
                points = np.nan_to_num(_matrix(centres.values.field("vec")))
                along = points - points.mean(axis=0)
                order = np.argsort(along @ np.linalg.svd(along, full_matrices=False)[2][0], kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lead.as_py()] * len(order), pa.int64()), centres.values.field("id").take(pa.array(order)),
                     pa.array(np.arange(len(order)))], names=["lead", "head", "turn"])

    return heads.select("lead", "_centres").mapInArrow(run, "lead bigint, head bigint, turn bigint")


def _centres(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """One row (key, _centres) per key, in the order of the centres' ids."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "vec", *more))).alias("_centres"))


def _pivots(d: DataFrame, params: NeighbourParams) -> DataFrame:
    """Written (scale, vec, lead, id): a share of the rows, drawn by hash; equal vectors once; at least one lead per scale."""
    span = float(1 << 40)
    drawn = d.withColumn("_draw", F.pmod(F.xxhash64("d_vec", F.lit(params.seed)), F.lit(1 << 40)))
    counted = drawn.groupBy("scale").agg(F.count(F.lit(1)).alias("_n"), F.min("_draw").alias("_first"))
    wanted = F.greatest(F.col("_n") / F.lit(2.0 * params.block_rows), F.lit(1.0))
    share = lambda number: (F.col("_draw") < F.lit(span) * number / F.col("_n")) | (F.col("_draw") == F.col("_first"))
    taken = drawn.join(counted, "scale").filter(share(wanted)).withColumn("_lead", share(F.sqrt(wanted)))
    return cut(taken.groupBy("scale", "vec").agg(F.max("_lead").alias("lead")).withColumn("id", F.monotonically_increasing_id()), "pivots")


def _table_name(place: str) -> str:
    return "resight_index_" + hashlib.sha256(place.encode()).hexdigest()[:24]


def write_index(database: DataFrame, place: str, params: NeighbourParams = NeighbourParams()) -> StoredIndex:
    """Store database(scale, vec_id, vec, target) as an index under a fresh path; `info`, written last, says it is whole."""
    spark = database.sparkSession
    empty_q = database.select(F.lit(0).alias("query_id"), "scale", "vec_id", "vec")
    d = _renamed(empty_q, database)[1].filter("scale is not null and vec is not null")
    pivots = _pivots(d, params)
    leads = pivots.filter("lead")
    first = W.partitionBy("scale").orderBy("id")
    leads = leads.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= params.db_block_rows)
    heads = cut(_centres(leads, "scale").withColumn("lead", F.col("_centres")[0]["id"]), "heads")
    # A head is the first cell of its own.
    homed = _nearest(_bunch(pivots.select("scale", "vec", "id"), "scale").join(heads, "scale"), "scale", "near")
    kept = leads.select(F.col("id").alias("_lead"))
    homed = homed.join(kept, homed["id"] == kept["_lead"], "left").withColumn("head", F.coalesce("_lead", "near"))
    own = W.partitionBy("head").orderBy(F.col("id") != F.col("head"), "id")
    pivot_cells = cut(
        homed.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= params.db_block_rows).select("head", "id", "vec"), "cells")
    cells = _centres(pivot_cells, "head")
    at_head = cut(_nearest(_bunch(d, "scale").join(heads, "scale"), "scale", "head", "far_head"), "at-head")
    columns = ["scale", "d_vec", "target", "vec", "far_head"]
    packed = blocks.pack(at_head, ["head"], "d_vec", columns, params.block_rows)
    placed = cut(_nearest(packed.join(cells, "head"), "head", "cell", "far"), "placed")

    salted = params.db_block_rows * params.blocks_per_salt
    sizes = placed.groupBy("head", "cell").agg(
        F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n"),
        F.ceil(F.count(F.lit(1)) / F.lit(salted)).cast("bigint").alias("salts"))
    in_head = W.partitionBy("head").orderBy("cell")
    sizes = cut(sizes.withColumn("_before", F.sum("n").over(in_head) - F.col("n")), "sizes")
    # Places of the heads in the row of their scale's cells, and with them the parts.
    reach = placed.groupBy("head").agg(F.min("far_head").alias("low"), F.max("far_head").alias("high"), F.count(F.lit(1)).alias("_n"))
    rows, total = F.lit(params.part_rows), F.sum("_n").over(W.partitionBy("lead"))
    parts = F.least(F.ceil(total / rows), F.greatest(F.lit(params.max_parts), F.ceil(total / F.lit(params.full_part))))
    in_scale = W.partitionBy("lead").orderBy("turn")
    laid = cut(_turns(heads).join(reach, "head").withColumns({
        "_start": F.sum("_n").over(in_scale) - F.col("_n"), "_part_rows": F.ceil(total / parts).cast("bigint")}), "laid")
    part = lambda place: F.floor(place / F.col("_part_rows")).cast("bigint")
    with_reach = leads.select("scale", F.col("id").alias("head"), "vec").join(laid, "head").withColumns({
        "id": F.col("head"), "first": part(F.col("_start")), "last": part(F.col("_start") + F.col("_n") - 1)})
    centres = _centres(with_reach, "scale", "low", "high", "first", "last")
    centres.join(heads.select("scale", "lead"), "scale").write.parquet(f"{place}/heads")
    with_size = sizes.withColumn("id", F.col("cell")).join(pivot_cells.select("id", "vec"), "id")
    _centres(with_size, "head", "low", "high", "salts", "n").write.parquet(f"{place}/cells")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = _blocks_of(params)[1]
    lies = sizes.join(laid.select("head", "lead", "_start", "_part_rows"), "head").select(
        "cell", "salts", "n", "lead", "_part_rows", (F.col("_start") + F.col("_before")).alias("_start"))
    spot = placed.join(lies, "cell").withColumns({
        "salt": F.pmod(F.xxhash64("d_vec"), F.col("salts")),
        "block": F.pmod(F.xxhash64("d_vec", F.lit(1)), F.ceil(F.col("n") / F.col("salts") / F.lit(params.db_block_rows)).cast("bigint")),
    })
    spot = spot.withColumn("_place", F.col("_start") + F.floor(F.col("salt") * F.col("n") / F.col("salts")).cast("bigint"))
    spot = spot.withColumns({"cell_part": part(F.col("_place")), "stretch": F.floor(F.col("_place") / F.lit(many)).cast("bigint")})
    stored = spot.groupBy(*PART, "cell", "salt", "block", "scale", "stretch").agg(F.collect_list(F.struct("d_vec", "target", "vec")).alias("_items"))
    stored.repartition(buckets, *PART).write.bucketBy(buckets, *PART).option("path", f"{place}/blocks").saveAsTable(_table_name(place))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{place}/info")
    discard(spark, pivots, heads, pivot_cells, at_head, placed, sizes, laid)
    return read_index(spark, place)


def read_index(spark: SparkSession, place: str) -> StoredIndex:
    """An index written before, in this session or another; its table is entered in the catalogue where it is unknown."""
    name, buckets = _table_name(place), spark.read.parquet(f"{place}/info").first()["buckets"]
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{place}/blocks").schema)
        by = ", ".join(PART)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}/blocks'")
    return StoredIndex(spark.read.parquet(f"{place}/heads"), spark.read.parquet(f"{place}/cells"), spark.table(name), buckets)


class _Reaching(_Asked):
    """Queries with a bound in one part; the cells of a stretch are skipped by balls around the means of what it holds of them."""

    def __init__(self, q: pa.StructArray, count: int):
        super().__init__(q, count, None, "")
        self.within = q.field("bound").to_numpy(zero_copy_only=False).copy()
        self.measured = 0

    def runs(self, d: pa.StructArray, vec: np.ndarray) -> list[tuple[slice | np.ndarray, np.ndarray]]:
        cells = d.field("cell").to_numpy()
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        sizes = np.diff(np.append(starts, len(cells)))
        means = np.add.reduceat(vec, starts, axis=0) / sizes[:, None]
        off = vec - np.repeat(means, sizes, axis=0)
        radii = np.sqrt(np.maximum.reduceat((off * off).sum(axis=1), starts))
        limit = self.within + _slack(self.vec, means)
        # What is not a number skips nothing.
        near = ~(np.sqrt(_squared(self.vec, means)) - radii[None, :] > limit[:, None])
        if near.mean(axis=0) @ sizes > 0.5 * len(vec):
            runs = [(np.flatnonzero(near.any(axis=1)), np.arange(len(vec)))]
        else:
            runs = [(np.flatnonzero(near[:, at]), np.arange(starts[at], starts[at] + sizes[at])) for at in np.flatnonzero(near.any(axis=0))]
        self.measured += sum(len(asked) * len(rows) for asked, rows in runs)
        return runs


def _stretch(blocks: pa.ListScalar) -> pa.StructArray:
    """The items of the blocks (cell, _items) of a stretch, with the number of their block as their cell."""
    lists = blocks.values.field("_items")
    sizes = np.diff(lists.offsets.to_numpy())
    items = lists.flatten()
    cells = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    return pa.StructArray.from_arrays([*items.flatten(), cells], names=[*(f.name for f in items.type), "cell"])


def _part_neighbours(batches: Iterator[pa.RecordBatch], schema: pa.Schema, count: int, measure: bool) -> Iterator[pa.RecordBatch]:
    """The best of every query block over all the stretches that follow each other beside it, or the number of pairs measured."""
    asked = known = scale = None

    def give() -> Iterator[pa.RecordBatch]:
        if asked is not None and measure:
            yield pa.RecordBatch.from_arrays([pa.array([scale.as_py()], schema.field("scale").type), pa.array([asked.measured])], schema=schema)
        elif asked is not None:
            yield from asked.found(scale, schema)

    for batch in batches:
        for r in range(batch.num_rows):
            key = tuple(batch.column(c)[r].as_py() for c in (*PART, "_qb"))
            if key != known:
                yield from give()
                known, scale = key, batch.column("scale")[r]
                asked = _Reaching(batch.column("_q")[r].values, count)
            asked.meet(_stretch(batch.column("_d")[r]))
    yield from give()


def _copies(queries: DataFrame, index: StoredIndex, count: int, params: NeighbourParams) -> DataFrame:
    """Queries (KEYS, vec, bound, _qb) with every part (cell_part, lead) that holds a head in reach.

    The cells of a query's nearest head bound the distance of its last neighbour.
    """
    q = queries.select("query_id", "scale", F.col("vec_id").alias("q_vec"), F.col("vec").cast("array<double>").alias("vec"))
    q = q.filter("scale is not null and vec is not null")
    columns = [*KEYS, "vec"]
    # Packing counts its rows first, so what is costly to find is written.
    at_head = cut(_nearest(_bunch(q, "scale").join(index.heads, "scale"), "scale", "head"), "at-head")
    packed = blocks.pack(at_head, ["head"], "q_vec", columns, params.block_rows)
    bounded = cut(_bounded(packed.join(index.cells, "head"), "head", count).select(*columns, "bound"), "bounded")
    discard(q.sparkSession, at_head)
    numbers = cut(bounded.groupBy("scale").agg(F.ceil(F.count(F.lit(1)) / F.lit(_blocks_of(params)[0])).cast("bigint").alias("_qbs")), "numbers")
    leads = index.heads.select("scale", "lead").join(numbers, "scale")
    reached = _in_reach(_bunch(bounded, "scale").join(index.heads, "scale"), "scale").join(leads, "scale")
    return reached.withColumn("_qb", F.pmod(F.xxhash64("query_id", "q_vec"), F.col("_qbs"))).drop("_qbs")


def _search(queries: DataFrame, index: StoredIndex, count: int, params: NeighbourParams, measure: bool = False) -> DataFrame:
    """What every part gives of the nearest; with `measure` (scale, measured): the pairs whose distance a task took.

    Only the queries are shuffled: to their nearest head, and into the buckets, once to each part in reach.
    """
    copies = _copies(queries, index, count, params)
    asked = copies.repartition(index.buckets, *PART).groupBy(
        *PART, "_qb", "scale").agg(F.collect_list(F.struct("query_id", "q_vec", "vec", "bound")).alias("_q"))
    held = index.blocks.groupBy(*PART, "stretch").agg(F.collect_list(F.struct("cell", "_items")).alias("_d"))
    # The left side is streamed: the stretches of a query block follow each other.
    met = asked.hint("merge").join(held, PART).select(*PART, "_qb", "scale", "_q", "_d")
    items = index.blocks.schema["_items"].dataType.elementType
    result = _result_schema(copies, copies.sparkSession.createDataFrame([], T.StructType([*items.fields])))
    if measure:
        result = T.StructType([result["scale"], T.StructField("measured", T.LongType())])
    schema = to_arrow_schema(result)
    return met.mapInArrow(lambda b: _part_neighbours(b, schema, count, measure), result)


def stored_neighbours(
    queries: DataFrame, index: StoredIndex, count: int, params: NeighbourParams = NeighbourParams()
) -> DataFrame:
    """The `count` nearest stored vectors of every query vector, as `neighbours` returns them.

    The cells of the nearest head bound the distance of the last neighbour, and what a part's cells have shown bounds it further.
    """
    return keep_nearest(_search(queries, index, count, params), count)


def measured_share(queries: DataFrame, index: StoredIndex, count: int, params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """(scale, measured, pairs): pairs of a query and a stored vector whose distance a search takes, and all pairs."""
    found = _search(queries, index, count, params, measure=True).groupBy("scale").agg(F.sum("measured").alias("measured"))
    asked = queries.filter("scale is not null and vec is not null").groupBy("scale").agg(F.count(F.lit(1)).alias("q"))
    rows = index.blocks.groupBy("scale").agg(F.sum(F.size("_items")).alias("n"))
    return found.join(asked, "scale").join(rows, "scale").select("scale", "measured", (F.col("q") * F.col("n")).alias("pairs"))

"""Approximate neighbours by a forest of projection trees, built and searched as tables.

A tree cuts the vectors of a scale in two by a plane, and the halves again, until a leaf holds a bounded number. A round
takes every leaf that is still too large, fits a few levels of planes on a bounded sample of it, and sends its rows down
these levels; all leaves of all trees take part in a round, so the number of rounds is that of the levels over
`levels`. Leaves are keys of packed blocks: no leaf and no level is ever in one place as a whole.

A search goes down the same rounds with the best `search_k` nodes of each query over all trees. A child on the query's
side of a plane has its parent's priority, the other one at most minus the distance to the plane; so the best nodes of
a round lead to the best leaves, and the result is that of a best-first search with this budget.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resight.functions.boxes import index_size
from resight.operators import blocks
from resight.operators.neighbours import _join_blocks, _matrix, _renamed, fold_copies, keep_nearest
from resight.params import ForestParams, NeighbourParams
from resight.session import cut

KEYS = ["scale", "tree", "node"]


@dataclass(frozen=True)
class Forest:
    """Rows (scale, tree, node, d_vec, vec, target) at their leaves, the planes of each round, and the search effort."""

    leaves: DataFrame
    planes: tuple[DataFrame, ...]
    trees: int
    search_k: int


def subtree(vectors: np.ndarray, levels: int) -> np.ndarray:
    """Planes (normal, offset) of a few levels in heap order, fitted on a sample; a plane of zeros does not cut.

    The normal leads from one of two far members to the other, the offset cuts the members as evenly as they can be.
    """
    planes = np.zeros((2**levels - 1, vectors.shape[1] + 1))
    members = {0: vectors}
    for at in range(len(planes)):
        here = members.pop(at, None)
        if here is None or len(here) < 2:
            continue
        first = here[((here - here.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        second = here[((here - first) ** 2).sum(axis=1).argmax()]
        long = np.sqrt(((second - first) ** 2).sum())
        if long == 0:
            continue
        normal = (second - first) / long
        place = here @ normal
        sorted_ = np.sort(place)
        steps = np.flatnonzero(sorted_[1:] > sorted_[:-1]) + 1
        if not steps.size:
            continue
        middle = steps[np.abs(steps - len(here) / 2).argmin()]
        planes[at, :-1], planes[at, -1] = normal, (sorted_[middle - 1] + sorted_[middle]) / 2
        right = place >= planes[at, -1]
        members[2 * at + 1], members[2 * at + 2] = here[~right], here[right]
    return planes


def descend(vectors: np.ndarray, planes: np.ndarray, levels: int) -> np.ndarray:
    """The path of every vector as a number of `levels` bits; a set bit is the side that the normal points to."""
    node, path = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    for _ in range(levels):
        right = (vectors * planes[node, :-1]).sum(axis=1) >= planes[node, -1]
        node, path = 2 * node + 1 + right, 2 * path + right
    return path


def reach(vectors: np.ndarray, priority: np.ndarray, planes: np.ndarray, levels: int) -> np.ndarray:
    """The priority of every path for every vector (rows, 2 ** levels); minus infinity where no plane leads."""
    found = priority[:, None]
    for level in range(levels):
        node = 2**level - 1 + np.arange(2**level)
        normal, offset = planes[node, :-1], planes[node, -1]
        margin = vectors @ normal.T - offset
        far = np.where((normal != 0).any(axis=1), np.minimum(found, -np.abs(margin)), -np.inf)
        sides = np.where(margin[..., None] >= 0, np.stack([far, found], axis=-1), np.stack([found, far], axis=-1))
        found = sides.reshape(len(vectors), -1)
    return found


def _planes_of(flat: pa.ListScalar, levels: int) -> np.ndarray:
    return flat.values.to_numpy(zero_copy_only=False).reshape(2**levels - 1, -1)


def _with_planes(df: DataFrame, planes: DataFrame, item: str, columns: list[str], rows: int) -> DataFrame:
    """Blocks of the rows whose node has planes, each with a copy of these."""
    cutting = df.join(planes.select(*KEYS), KEYS, "left_semi")
    return blocks.pack(cutting, KEYS, item, columns, rows).join(planes, KEYS)


def _moved(batches, schema: pa.Schema, levels: int):
    """Rows of blocks under their new nodes."""
    for batch in batches:
        for r in range(batch.num_rows):
            items = batch.column("_items")[r].values
            path = descend(_matrix(items.field("vec")), _planes_of(batch.column("planes")[r], levels), levels)
            node = batch.column("node")[r].as_py() * 2**levels + path
            same = pa.array([r] * len(items), pa.int64())
            columns = {"scale": batch.column("scale").take(same), "tree": batch.column("tree").take(same), "node": pa.array(node),
                       "open": pa.array([True] * len(items)), **{f.name: items.field(f.name) for f in items.type}}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _fitted(batches, schema: pa.Schema, levels: int):
    for batch in batches:
        made = [subtree(_matrix(batch.column("sample")[r].values), levels) for r in range(batch.num_rows)]
        keep = pa.array([bool(p[0].any()) for p in made], pa.bool_())
        columns = [*(batch.column(k) for k in KEYS), pa.array([p.ravel().tolist() for p in made], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([c.filter(keep).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def build_forest(database: DataFrame, params: ForestParams = ForestParams(), neighbour_params: NeighbourParams = NeighbourParams(),
                 count: int = 3) -> Forest:
    """A forest over database(scale, vec_id, vec, target), for searches of up to `count` neighbours.

    Trees and effort follow the index rule, from the largest number of targets in a scale, unless `trees` says otherwise.
    Leaves of equal vectors stay as they are: no plane cuts them, and their blocks are bounded all the same.
    """
    _, d = _renamed(database.select(F.lit(0).alias("query_id"), "scale", "vec_id", "vec"), database)
    rule, levels = params.index, params.levels
    most = d.groupBy("scale").agg(F.countDistinct("target").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    size = most.select(index_size(F.col("n"), rule.trees, rule.annots_per_tree, rule.k, rule.search_factor).alias("s")).first()["s"]
    trees, search_k = params.trees or size["trees"], params.search_k or size["search_k"]
    fields = d.schema
    walked = T.StructType([fields["scale"], T.StructField("tree", T.IntegerType()), T.StructField("node", T.LongType()),
                           T.StructField("open", T.BooleanType()), fields["d_vec"], fields["vec"], fields["target"]])
    arrow = to_arrow_schema(walked)
    fitted = T.StructType([*(walked[k] for k in KEYS), T.StructField("planes", T.ArrayType(T.DoubleType()))])
    arrow_planes = to_arrow_schema(fitted)
    state = fold_copies(d, count).select(
        "scale", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(True).alias("open"),
        "d_vec", "vec", "target")
    rounds = []
    while True:
        state = cut(state, "forest")
        large = state.where("open").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > params.leaf)
        large = cut(large, "large")
        if large.isEmpty():
            return Forest(state.drop("open"), tuple(rounds), trees, search_k)
        drawn = W.partitionBy(*KEYS).orderBy(F.xxhash64("d_vec", "tree", "node"), "d_vec")
        sample = state.join(large.select(*KEYS), KEYS, "left_semi").withColumn("_draw", F.row_number().over(drawn))
        sample = sample.where(F.col("_draw") <= params.sample).groupBy(*KEYS).agg(F.collect_list("vec").alias("sample"))
        planes = cut(sample.mapInArrow(lambda b: _fitted(b, arrow_planes, levels), fitted), "planes")
        rounds.append(planes)
        moving = _with_planes(state, planes, "d_vec", ["d_vec", "vec", "target"], neighbour_params.db_block_rows)
        moved = moving.mapInArrow(lambda b: _moved(b, arrow, levels), walked)
        stay = state.join(planes.select(*KEYS), KEYS, "left_anti").withColumn("open", F.lit(False))
        state = stay.unionByName(moved)


def _spread(batches, schema: pa.Schema, levels: int):
    """Query rows under every node that a round leads to, with its priority."""
    for batch in batches:
        for r in range(batch.num_rows):
            items = batch.column("_items")[r].values
            priority = items.field("priority").to_numpy(zero_copy_only=False)
            found = reach(_matrix(items.field("vec")), priority, _planes_of(batch.column("planes")[r], levels), levels)
            row, path = np.nonzero(found > -np.inf)
            rows, same = items.take(pa.array(row)), pa.array([r] * len(row), pa.int64())
            columns = {"scale": batch.column("scale").take(same), "tree": batch.column("tree").take(same),
                       "node": pa.array(batch.column("node")[r].as_py() * 2**levels + path), **{f.name: rows.field(f.name) for f in rows.type},
                       "priority": pa.array(found[row, path])}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def search_forest(
    queries: DataFrame, forest: Forest, count: int, params: ForestParams = ForestParams(),
    neighbour_params: NeighbourParams = NeighbourParams(),
) -> DataFrame:
    """The `count` nearest of what the `search_k` best leaves of every query vector hold; ties to the smaller id."""
    q = queries.select("query_id", "scale", F.col("vec_id").alias("q_vec"), F.col("vec").cast("array<double>").alias("vec"))
    fields, levels = q.schema, params.levels
    walked = T.StructType([fields["query_id"], fields["scale"], fields["q_vec"], fields["vec"], T.StructField("tree", T.IntegerType()),
                           T.StructField("node", T.LongType()), T.StructField("priority", T.DoubleType())])
    arrow = to_arrow_schema(walked)
    front = q.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1)))).withColumns(
        {"node": F.lit(1).cast("long"), "priority": F.lit(0.0)})
    best = W.partitionBy("query_id", "scale", "q_vec").orderBy(F.desc("priority"), "tree", "node")
    for planes in forest.planes:
        spread = _with_planes(front, planes, "q_vec", ["query_id", "q_vec", "vec", "priority"], neighbour_params.block_rows)
        spread = spread.mapInArrow(lambda b: _spread(b, arrow, levels), walked)
        both = front.join(planes.select(*KEYS), KEYS, "left_anti").unionByName(spread)
        front = cut(both.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= forest.search_k).drop("_place"), "front")
    found = _join_blocks(front.drop("priority"), forest.leaves, KEYS, count, neighbour_params)
    return keep_nearest(found.dropDuplicates(["query_id", "scale", "q_vec", "d_vec"]), count)


def forest_neighbours(queries: DataFrame, database: DataFrame, count: int, params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """Build a forest and search it: the `forest` method of `neighbours`. Keep the forest for more than one search."""
    chosen = params.forest
    return search_forest(queries, build_forest(database, chosen, params, count), count, chosen, params)

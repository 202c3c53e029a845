"""Pack rows into bounded blocks and let blocks meet by an equi join.

A block is one row holding at most about `block_rows` items of one key, so a task works on
two blocks at a time however large a key is. Keys with more items than one block are cut by a
hash of the item id; the number of blocks of such a key comes from a grouped count, which
Spark combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resight.session import cut_and_observe


def large_keys(df: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Keys that need more than one block, with their number of blocks."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    return counted.filter(F.col("_n") > block_rows).select(*keys, blocks.alias("_blocks"))


def pack(
    df: DataFrame, keys: list[str], item: str, columns: list[str], block_rows: int, large: DataFrame | None = None
) -> DataFrame:
    """Rows (keys, block, _items array<struct>) with at most about `block_rows` items each."""
    big = large_keys(df, keys, block_rows) if large is None else large
    spot = F.pmod(F.xxhash64(F.col(item)), F.coalesce(F.col("_blocks"), F.lit(1)).cast("bigint"))
    # The join picks broadcast or a skew-split shuffle from the measured size of `big`.
    return (
        df.join(big, keys, "left")
        .withColumn("block", spot)
        .groupBy(*keys, "block")
        .agg(F.collect_list(F.struct(*columns)).alias("_items"))
    )


def meet(
    left: DataFrame, right: DataFrame, keys: list[str], large_left: DataFrame, large_right: DataFrame,
    blocks_per_salt: int, deal_out: bool = False,
) -> DataFrame:
    """Every left block of a key beside every right block of the same key.

    Blocks of a large key are spread over salts on both sides, and each side is copied to the
    salts of the other: the meetings of one key form a grid of cells with at most
    `blocks_per_salt` x `blocks_per_salt` meetings, each cell its own join key. Most keys are not
    large and have one cell.

    Both sides are partitioned with the session's shuffle partition count as an explicit number:
    the rows are few but expensive, so they must not be merged into few tasks by their byte
    size. With `deal_out` the meetings themselves are dealt evenly over tasks, which pays when
    one meeting costs far more than moving it.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(side: DataFrame, own: str, other: str, large_other: DataFrame) -> DataFrame:
        salts = large_other.select(*keys, F.ceil(F.col("_blocks") / F.lit(blocks_per_salt)).cast("bigint").alias("_salts"))
        return (
            side.withColumn(own, F.floor(F.col("block") / F.lit(blocks_per_salt)).cast("bigint"))
            .join(salts, keys, "left")
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)))
            .drop("_salts", "block")
            .repartition(tasks, *keys, "l_salt", "r_salt")
        )

    # Copies make the real size larger than the planner's estimate, so no side may be broadcast.
    met = spread(left, "l_salt", "r_salt", large_right).hint("merge").join(
        spread(right, "r_salt", "l_salt", large_left), [*keys, "l_salt", "r_salt"]
    )
    return met.repartition(tasks) if deal_out else met


def pack_rows(df: DataFrame, block_rows: int, name: str, whole: str | None = None) -> tuple[DataFrame, int]:
    """Written rows (no, `name` array<struct>) of up to `block_rows` rows of a partition each, and how many there are.

    For rows that all meet all others there is no key to shuffle by: blocks are filled where the rows are. With `whole`
    rows that lie side by side and are equal in that column stay in one block; there must be `block_rows` of them at most.
    """
    block = T.StructType([T.StructField(name, T.ArrayType(df.schema))])
    kind = to_arrow_schema(block).field(0).type

    def give(part: pa.RecordBatch) -> pa.RecordBatch:
        items = pa.StructArray.from_arrays([part.column(f.name).cast(f.type) for f in kind.value_type], fields=list(kind.value_type))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items).cast(kind)], names=[name])

    def ends(rows: pa.RecordBatch) -> np.ndarray:
        """Places where a block may end."""
        if whole is None:
            return np.arange(1, rows.num_rows + 1)
        codes = rows.column(whole).dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.append(np.flatnonzero(np.diff(codes)) + 1, rows.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            spots, begin = ends(held), 0
            # What comes next may belong to the last rows held, so these are kept until they are more than a block.
            while held.num_rows - begin > block_rows:
                end = int(spots[np.searchsorted(spots, begin + block_rows, side="right") - 1])
                end = end if end > begin else begin + block_rows  # rows without a key, however many
                yield give(held.slice(begin, end - begin))
                begin = end
            held = held.slice(begin)
        if held is not None:
            yield give(held)

    packed = df.mapInArrow(run, block).withColumn("no", F.monotonically_increasing_id())
    table, seen = cut_and_observe(packed, "blocks", F.count(F.lit(1)).alias("n"))
    return table, seen["n"]


def pack_wholes(df: DataFrame, key: str, block_rows: int, name: str) -> list[tuple[DataFrame, int]]:
    """As `pack_rows`, with all rows of a key in one block: one table, and a second one if keys have more rows than a block.

    Blocks of the second table hold rows of such keys only, filled where the rows are.
    """
    large, seen = cut_and_observe(large_keys(df, [key], block_rows).select(key), "large", F.count(F.lit(1)).alias("n"))
    few = df.join(large, key, "left_anti") if seen["n"] else df
    # Neighbours in the order of the key fill a block together.
    out = [pack_rows(few.select(df.columns).repartition(key).sortWithinPartitions(key), block_rows, name, key)]
    if seen["n"]:
        out.append(pack_rows(df.join(large, key, "left_semi").select(df.columns), block_rows, name))
    return out


#: Rows and columns of a grid at most, and so the copies of a block, however many blocks there are.
GRID = 48


def _grid(n_left: int, n_right: int, per_key: int, most_right: int = GRID) -> tuple[int, int]:
    return tuple(min(max(-(-n // per_key), min(n, 24), 1), most) for n, most in ((n_left, GRID), (n_right, most_right)))


def _copied(side: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
    """Every block in one of its side's `parts`, and once for each of the other side's."""
    spot = F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int")
    return side.withColumn(own, spot).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).drop("no")


def meet_all(left: DataFrame, right: DataFrame, n_left: int, n_right: int, per_key: int) -> DataFrame:
    """Every left block beside every right block: a join on a grid of keys with about `per_key` blocks of each side, or fewer
    while the grid is small: its keys are dealt to tasks by hash, which is even only for many of them. A grid of `GRID` rows and
    columns grows no more: its keys take more blocks.

    Each side is shuffled once, into the session's number of shuffle partitions: meetings are few but expensive, so they
    must not be merged into few tasks by their byte size.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, cols = _grid(n_left, n_right, per_key)
    sides = _copied(left, "_row", rows, "_col", cols), _copied(right, "_col", cols, "_row", rows)
    first, second = (side.repartition(tasks, "_row", "_col") for side in sides)
    return first.hint("merge").join(second, ["_row", "_col"])


def deal_all(left: DataFrame, right: DataFrame, n_left: int, n_right: int, per_key: int, most_right: int = GRID) -> DataFrame:
    """As `meet_all`, with a block once in a key instead of once in each of its meetings: rows (_row, _col, left's column,
    right's column), one of them null. The rows of a key lie in one task and follow each other, those of the left side first.

    The grid has no more than `most_right` columns.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, cols = _grid(n_left, n_right, per_key, most_right)
    first, second = _copied(left, "_row", rows, "_col", cols), _copied(right, "_col", cols, "_row", rows)
    mine, other = (next(c for c in side.columns if c not in ("_row", "_col")) for side in (first, second))
    both = first.withColumn(other, F.lit(None).cast(second.schema[other].dataType)).unionByName(
        second.withColumn(mine, F.lit(None).cast(first.schema[mine].dataType)))
    return both.select("_row", "_col", mine, other).repartition(tasks, "_row", "_col").sortWithinPartitions("_row", "_col", F.col(mine).isNull())

"""Bounded pieces of long ordered series.

A series is rows (keys..., idx, payload...) with a dense 0-based idx. Windows over a
whole series would put one long series into one task, so ordered operators work on
tiles: `tile = floor(idx / size)`, plus copies of the few rows near a tile's border
(the halo). Every window is then partitioned by (keys, tile) and holds at most
`size + 2 * halo` rows, whatever the length of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 4096


def tile_of(idx: Column, size: int = TILE) -> Column:
    return F.floor(idx / F.lit(size)).cast("bigint")


def with_halo(df: DataFrame, halo: int = 0, idx: str = "idx", size: int = TILE) -> DataFrame:
    """Add `tile` and `core`; rows near a border are copied to the neighbour tile."""
    if halo > size:
        raise ValueError("the halo must not be longer than a tile")
    own = tile_of(F.col(idx), size)
    if halo == 0:
        return df.withColumn("tile", own).withColumn("core", F.lit(True))
    homes = F.array_distinct(F.array(own, tile_of(F.col(idx) - halo, size), tile_of(F.col(idx) + halo, size)))
    return df.withColumn("tile", F.explode(homes)).withColumn("core", F.col("tile") == own)


def tile_window(keys: list[str], idx: str = "idx"):
    return W.partitionBy(*keys, "tile").orderBy(idx)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("core").drop("core", "tile")


def spread(facts: DataFrame, n: str = "n", size: int = TILE, margin: int = 0) -> DataFrame:
    """One copy of a per-series fact row for each tile of the series.

    Joining facts on (keys, tile) instead of keys alone keeps a long series spread out.
    """
    first = tile_of(F.lit(-margin), size)
    last = tile_of(F.col(n) - 1 + margin, size)
    return facts.withColumn("tile", F.explode(F.sequence(first, last)))


def series_facts(df: DataFrame, keys: list[str], *aggs: Column, idx: str = "idx") -> DataFrame:
    """Length n of each series plus further aggregates; partial sums happen before the shuffle."""
    return df.groupBy(*keys).agg((F.max(idx) + 1).cast("bigint").alias("n"), *aggs)


def attach(df: DataFrame, facts: DataFrame, keys: list[str], size: int = TILE, margin: int = 0) -> DataFrame:
    """Join per-series facts (with their length `n`) to tiled rows."""
    return df.join(spread(facts, "n", size, margin), [*keys, "tile"])


def running_total(
    df: DataFrame, keys: list[str], value: str, out: str, idx: str = "idx", size: int = TILE
) -> DataFrame:
    """Cumulative sum along each series in two levels: inside tiles, then across tile totals."""
    tiled = df.withColumn("tile", tile_of(F.col(idx), size))
    inner = tile_window(keys, idx).rowsBetween(W.unboundedPreceding, 0)
    inside = tiled.withColumn("_inside", F.sum(value).over(inner))
    before = W.partitionBy(*keys).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        inside.groupBy(*keys, "tile")
        .agg(F.sum(value).alias("_total"))
        .select(*keys, "tile", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    return (
        inside.join(totals, [*keys, "tile"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", "tile")
    )


def dense_index(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "idx") -> DataFrame:
    """0-based position inside each key by `order`, without sorting a whole key in one task.

    `bucket` must be monotone in the order (for example the day of a time stamp): rows are
    numbered inside a bucket and shifted by the number of rows in earlier buckets.
    """
    cut = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(shifts, [*keys, "_bucket"])
        .withColumn(out, (F.col("_shift") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_shift", "_inside")
    )

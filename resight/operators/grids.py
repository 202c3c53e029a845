"""Weighted cell grids: grid(grid_id, row, col, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_centroid(grid: DataFrame) -> DataFrame:
    """Whole-cell centre of mass per grid, halves to even; null where all weights are 0."""
    total = F.sum("w")
    sums = grid.groupBy("grid_id").agg(
        total.alias("_w"), F.sum(F.col("w") * F.col("row")).alias("_r"), F.sum(F.col("w") * F.col("col")).alias("_c")
    )
    weight = F.when(F.col("_w") != 0, F.col("_w"))
    return sums.select("grid_id", F.rint(F.col("_r") / weight).cast("bigint").alias("row"),
                       F.rint(F.col("_c") / weight).cast("bigint").alias("col"))


def dominant_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells strictly greatest in both their row and their column, away from the border.

    The border is the outermost row and column of the part named by `keys`. Row, column and part
    extremes are grouped aggregates (no sort of a row); a tie shows as a second cell at the
    maximum.
    """
    frame = cells.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"),
                                     F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    out = cells
    for line in ("row", "col"):
        top = cells.groupBy(*keys, line).agg(F.max("w").alias("_top"))
        at_top = cells.join(top, [*keys, line]).filter(F.col("w") == F.col("_top"))
        alone = at_top.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("_n"), F.max("w").alias("w"))
        out = out.join(alone.filter("_n = 1").drop("_n"), [*keys, line, "w"], "left_semi")
    inside = (
        (F.col("row") > F.col("_r0")) & (F.col("row") < F.col("_r1"))
        & (F.col("col") > F.col("_c0")) & (F.col("col") < F.col("_c1"))
    )
    return out.join(frame, keys).filter(inside).drop("_r0", "_r1", "_c0", "_c1")


def end_cells(grid: DataFrame, kind: str) -> DataFrame:
    """Start and end cell of a contour: (grid_id, start_row, start_col, end_row, end_col), null if none.

    'dorsal' looks at and below the centroid, left half for the leftmost and right half for the
    rightmost dominant cell. 'fluke' takes the dominant cells nearest the upper corners.
    """
    middle = weighted_centroid(grid).select("grid_id", F.col("row").alias("_mr"), F.col("col").alias("_mc"))
    size = grid.groupBy("grid_id").agg(F.max("col").alias("_last"))
    halves = grid.join(middle, "grid_id").withColumn("half", F.when(F.col("col") < F.col("_mc"), "lead").otherwise("trail"))
    if kind == "dorsal":
        halves = halves.filter(F.col("row") >= F.col("_mr"))
        lead_key: Column = F.struct(F.col("col").alias("k"), "row")
        trail_key: Column = F.struct((-F.col("col")).alias("k"), "row")
    elif kind == "fluke":
        lead_key = F.struct((F.col("row") ** 2 + F.col("col") ** 2).alias("k"), "row")
        trail_key = F.struct((F.col("row") ** 2 + (F.col("col") - F.col("_last")) ** 2).alias("k"), "row")
    else:
        raise ValueError(f"unknown kind {kind}")
    cells = dominant_cells(halves.select("grid_id", "half", "row", "col", "w"), ["grid_id", "half"]).join(size, "grid_id")
    best = cells.groupBy("grid_id").agg(
        F.min(F.when(F.col("half") == "lead", F.struct(lead_key.alias("k"), F.col("row"), F.col("col")))).alias("_s"),
        F.min(F.when(F.col("half") == "trail", F.struct(trail_key.alias("k"), F.col("row"), F.col("col")))).alias("_e"),
    )
    return size.select("grid_id").join(best, "grid_id", "left").select(
        "grid_id", F.col("_s.row").alias("start_row"), F.col("_s.col").alias("start_col"),
        F.col("_e.row").alias("end_row"), F.col("_e.col").alias("end_col"),
    )

"""Box arithmetic on x, y, w, h columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float) -> Column:
    """Box grown by a share of its size and cut to the frame.

    The whole frame is used only when x, y, w and h are all negative.
    """
    grow_x = (w * F.lit(pad)).cast("bigint")
    grow_y = (h * F.lit(pad)).cast("bigint")
    grown = F.struct(
        F.greatest(F.lit(0), x - grow_x).cast("bigint").alias("x0"),
        F.greatest(F.lit(0), y - grow_y).cast("bigint").alias("y0"),
        F.least(width, x + w + grow_x).cast("bigint").alias("x1"),
        F.least(height, y + h + grow_y).cast("bigint").alias("y1"),
    )
    whole = F.struct(
        F.lit(0).cast("bigint").alias("x0"),
        F.lit(0).cast("bigint").alias("y0"),
        width.cast("bigint").alias("x1"),
        height.cast("bigint").alias("y1"),
    )
    return F.when((x >= 0) | (y >= 0) | (w >= 0) | (h >= 0), grown).otherwise(whole)


def mirrored_x(x: Column, w: Column, width: Column, is_right: Column) -> Column:
    return F.when(is_right, width - (x + w)).otherwise(x)


def part_box_valid(w: Column, h: Column) -> Column:
    return (w > 5) & (h > 5)


def annot_box_valid(w: Column, h: Column) -> Column:
    return w.isNotNull() & h.isNotNull() & (w != 0) & (h != 0)


def clamp_to_frame(value: Column, size: Column) -> Column:
    """Clip to the frame, then cut to a whole cell number."""
    return F.least(F.greatest(value, F.lit(0.0)), (size - 1).cast("double")).cast("int")


def index_size(num_annots: Column, trees: int = 10, per_tree: int = 2500, k: int = 2, factor: int = 1) -> Column:
    """Number of tables and search effort for a collection of this size."""
    wanted = F.greatest(F.lit(trees).cast("bigint"), F.ceil(num_annots / F.lit(per_tree)).cast("bigint"))
    return F.struct(wanted.alias("trees"), (wanted * F.lit(k * factor)).cast("bigint").alias("search_k"))

"""Training tables from part contours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.functions import boxes, text
from resight.operators import filters as R
from resight.operators.tiles import dense_index


def train_names(names: DataFrame, train_share: float = 0.8, seed: int = 0) -> DataFrame:
    """(name, is_train): exactly the given share of names by hash order, so no name is on both sides.

    Names are numbered inside buckets of their hash prefix, not in one task.
    """
    keyed = names.select("name").distinct().withColumns(
        {"_key": text.shuffle_key(seed, F.col("name")), "_one": F.lit(0)}
    )
    placed = dense_index(keyed, ["_one"], ["_key", "name"], F.substring("_key", 1, 2), out="_place")
    total = placed.agg(F.count(F.lit(1))).scalar()
    return placed.select("name", (F.col("_place") < F.floor(total * F.lit(train_share))).alias("is_train"))


def named_parts(parts: DataFrame, annots: DataFrame) -> DataFrame:
    """Usable parts with their annotation; every unknown animal gets its own name.

    Boxes, names and contours travel in one keyed row, so filtering cannot misalign them.
    """
    joined = parts.join(annots, "aid")
    usable = R.valid_boxes(joined.withColumn("n_points", F.coalesce(F.size("segment"), F.lit(0))))
    return usable.withColumn("name", text.own_name_if_unknown(F.col("name"), F.col("part_id")))


def prepare_training_table(
    parts: DataFrame, annots: DataFrame, train_share: float = 0.8, mirror: bool = True, seed: int = 0
) -> DataFrame:
    """(image, name, contour_id, idx, x, y, r, occluded, is_train), one row per contour point.

    parts(part_id, aid, part_x, part_y, part_w, part_h, begin, end, segment),
    annots(aid, image, name, viewpoint, annot_w, annot_h, im_width).
    """
    named = named_parts(parts, annots)
    right = text.contains_right(F.col("viewpoint"))
    if mirror:
        named = named.withColumns({
            "x0": boxes.mirrored_x(F.col("part_x"), F.col("part_w"), F.col("im_width"), right),
            "segment": F.when(right, R.mirrored_segment(F.col("segment"))).otherwise(F.col("segment")),
            "image": F.when(right, F.concat(F.col("image"), F.lit("-mirrored"))).otherwise(F.col("image")),
        })
    else:
        named = named.withColumn("x0", F.col("part_x"))
    turned = named.withColumn("_t", R.left_to_right(F.col("segment"), F.col("begin"), F.col("end")))
    boxed = turned.select(
        "image", "name", F.col("part_id").alias("contour_id"), F.col("x0"), F.col("part_y").alias("y0"),
        F.col("part_w").alias("w"), F.col("part_h").alias("h"), F.col("_t.segment").alias("segment"),
    )
    flags = train_names(named, train_share, seed)
    points = R.absolute_points(boxed.join(flags, "name"))
    return points.select("image", "name", "contour_id", "idx", "x", "y", "r", "occluded", "is_train")

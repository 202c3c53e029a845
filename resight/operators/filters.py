"""Row rules of rosters, annotations and part records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.functions import boxes, text


def with_flip(annots: DataFrame, viewpoint: str = "viewpoint") -> DataFrame:
    return annots.withColumn("flip", text.flip_flag(F.col(viewpoint)))


def good_quality(
    catalogue: DataFrame, grades: list[str], years: list[int], taken: Column, rating: str = "rating",
    worst_sum: int = 11, ratings: tuple[str, ...] = ("D1", "D2"),
) -> DataFrame:
    """Sum of the grade codes within the limit, distinct enough, and from one of the years."""
    total = sum((F.col(g) for g in grades[1:]), F.col(grades[0]))
    # The span of the years follows from the list; unlike year() it reaches the file scan.
    span = (taken >= F.lit(f"{min(years)}-01-01")) & (taken < F.lit(f"{max(years) + 1}-01-01"))
    return catalogue.filter(span & (total <= worst_sum) & F.col(rating).isin(*ratings) & F.year(taken).isin(*years))


def known_names(roster: DataFrame, placeholder: str = text.UNKNOWN) -> DataFrame:
    return roster.filter(F.col("individual") != placeholder)


def valid_boxes(parts: DataFrame) -> DataFrame:
    """Part and annotation boxes of usable size and a contour that has points."""
    return parts.filter(
        boxes.part_box_valid(F.col("part_w"), F.col("part_h"))
        & boxes.annot_box_valid(F.col("annot_w"), F.col("annot_h"))
        & (F.col("n_points") > 0)
    )


def successes(results: DataFrame, flag: str = "success") -> DataFrame:
    return results.filter(F.col(flag))


def mirrored_segment(segment: Column) -> Column:
    """Mirror an array of (x, y, r, flag) points in a unit-wide frame."""
    return F.transform(
        segment,
        lambda p: F.struct((1.0 - p["x"]).alias("x"), p["y"].alias("y"), p["r"].alias("r"), p["flag"].alias("flag")),
    )


def left_to_right(segment: Column, begin: Column, end: Column) -> Column:
    """Reverse a segment that runs right to left and re-map its begin and end."""
    wrong = F.get(segment, begin)["x"] > F.get(segment, end)["x"]
    last = F.size(segment) - 1
    return F.when(
        wrong, F.struct((last - end).alias("begin"), (last - begin).alias("end"), F.reverse(segment).alias("segment"))
    ).otherwise(F.struct(begin.alias("begin"), end.alias("end"), segment.alias("segment")))


def absolute_points(parts: DataFrame) -> DataFrame:
    """One row per contour point in image coordinates; radius is half the relative one times the width."""
    exploded = parts.select("*", F.posexplode("segment").alias("idx", "_p"))
    return exploded.withColumns({
        "x": F.col("_p.x") * F.col("w") + F.col("x0"),
        "y": F.col("_p.y") * F.col("h") + F.col("y0"),
        "r": F.col("_p.r") * F.col("w") / 2.0,
        "occluded": F.col("_p.flag"),
    }).drop("_p", "segment")


def train_rows(table: DataFrame) -> DataFrame:
    return table.filter("is_train")


def validation_rows(table: DataFrame) -> DataFrame:
    return table.filter(~F.col("is_train"))


def normalised_anchors(points: DataFrame, box: DataFrame) -> DataFrame:
    """First and last point of each contour as shares of its box (x0, y0, x1, y1)."""
    ends = points.groupBy("contour_id").agg(
        F.min_by(F.struct("x", "y"), "idx").alias("_s"), F.max_by(F.struct("x", "y"), "idx").alias("_e")
    )
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    wide, high = F.when(width != 0, width), F.when(height != 0, height)
    return ends.join(box, "contour_id").select(
        "contour_id",
        ((F.col("_s.x") - F.col("x0")) / wide).alias("start_x"), ((F.col("_s.y") - F.col("y0")) / high).alias("start_y"),
        ((F.col("_e.x") - F.col("x0")) / wide).alias("end_x"), ((F.col("_e.y") - F.col("y0")) / high).alias("end_y"),
    )


def contour_box(points: DataFrame, pad: float, width: Column, height: Column, variant: str = "coarse") -> DataFrame:
    """Box around a contour including each point's radius, padded and cut to the frame.

    The coarse variant leaves the left side unpadded; the anchor variant pads it and measures
    the right padding from the moved left side.
    """
    xi, yi, ri = F.rint("x").cast("bigint"), F.rint("y").cast("bigint"), F.floor("r").cast("bigint")
    raw = points.groupBy("contour_id").agg(
        (F.min(xi - ri) - 1).alias("a0"), (F.max(xi + ri) + 1).alias("a1"),
        (F.min(yi - ri) - 1).alias("b0"), (F.max(yi + ri) + 1).alias("b1"),
    )
    p = F.lit(float(pad))
    left = F.col("a0") - p * (F.col("a1") - F.col("a0")) if variant == "anchor" else F.col("a0").cast("double")
    moved = raw.withColumn("x0", left)
    moved = moved.withColumn("x1", F.col("a1") + p * (F.col("a1") - F.col("x0")))
    moved = moved.withColumn("y0", F.col("b0") - p * (F.col("b1") - F.col("b0")))
    moved = moved.withColumn("y1", F.col("b1") + p * (F.col("b1") - F.col("y0")))

    def cut(name: str, size: Column) -> Column:
        return F.least(F.greatest(F.col(name), F.lit(0.0)), size.cast("double")).alias(name)

    return moved.select("contour_id", cut("x0", width), cut("y0", height), cut("x1", width), cut("y1", height))

"""Ordered point and value series: trimming, direction, resampling, smoothing, extrema."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resight.operators import tiles
from resight.operators.tiles import TILE

CONTOUR = ["contour_id"]


def trim(points: DataFrame, amount: int, keys: list[str] = CONTOUR, size: int = TILE) -> DataFrame:
    """Drop `amount` points at both ends where the contour has more than twice as many."""
    if amount <= 0:
        return points
    tiled = tiles.with_halo(points, size=size)
    joined = tiles.attach(tiled, tiles.series_facts(points, keys), keys, size)
    inner = (F.col("idx") >= amount) & (F.col("idx") < F.col("n") - amount)
    kept = joined.filter((F.col("n") <= 2 * amount) | inner)
    moved = F.when(F.col("n") > 2 * amount, F.col("idx") - amount).otherwise(F.col("idx"))
    return tiles.core_rows(kept.withColumn("idx", moved)).drop("n")


def to_xy(points: DataFrame, transposed: bool | Column) -> DataFrame:
    """Matrix (i, j) points as (x, y); transposed parts keep their order of axes."""
    flag = transposed if isinstance(transposed, Column) else F.lit(transposed)
    x = F.when(flag, F.col("i")).otherwise(F.col("j"))
    y = F.when(flag, F.col("j")).otherwise(F.col("i"))
    return points.withColumns({"x": x.cast("double"), "y": y.cast("double")}).drop("i", "j")


def orient(
    points: DataFrame, must_reverse: Column, keys: list[str] = CONTOUR, carry: dict[str, str] | None = None,
    size: int = TILE,
) -> DataFrame:
    """Reverse a contour where `must_reverse` holds.

    `must_reverse` is written over x_first, y_first, x_last, y_last. Columns named in `carry`
    hold begin and end positions, which swap and are re-mapped on reversal.
    """
    ends = tiles.series_facts(
        points, keys,
        F.min_by("x", "idx").alias("x_first"), F.min_by("y", "idx").alias("y_first"),
        F.max_by("x", "idx").alias("x_last"), F.max_by("y", "idx").alias("y_last"),
    )
    facts = ends.select(*keys, "n", must_reverse.alias("_rev"))
    out = tiles.attach(tiles.with_halo(points, size=size), facts, keys, size)
    last = F.col("n") - 1
    new = {"idx": F.when(F.col("_rev"), last - F.col("idx")).otherwise(F.col("idx"))}
    if carry:
        begin, end = carry["begin"], carry["end"]
        new[begin] = F.when(F.col("_rev"), last - F.col(end)).otherwise(F.col(begin))
        new[end] = F.when(F.col("_rev"), last - F.col(begin)).otherwise(F.col(end))
    return tiles.core_rows(out.withColumns(new)).drop("n", "_rev")


def wrong_direction(part: str) -> Column:
    """Flukes and dorsal fins run by rising x; ears run by falling y."""
    kind = part.lower()
    if kind in ("fluke", "dorsal"):
        return F.col("x_first") > F.col("x_last")
    if kind in ("left ear", "right ear"):
        return F.col("y_first") < F.col("y_last")
    raise ValueError(f"no direction is defined for {part}")


def arc_length(points: DataFrame, keys: list[str] = CONTOUR, size: int = TILE) -> DataFrame:
    """Add `u`, the length travelled from the first point."""
    w = tiles.tile_window(keys)
    dx = F.col("x") - F.lag("x").over(w)
    dy = F.col("y") - F.lag("y").over(w)
    stepped = tiles.with_halo(points, 1, size=size).withColumn(
        "_step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    )
    return tiles.running_total(tiles.core_rows(stepped), keys, "_step", "u", size=size).drop("_step")


def trapezoid(points: DataFrame, keys: list[str] = CONTOUR, size: int = TILE) -> DataFrame:
    """Integral of y over x by trapezoids, one row per series."""
    w = tiles.tile_window(keys)
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2.0
    pieces = tiles.core_rows(tiles.with_halo(points, 1, size=size).withColumn("_area", area))
    return pieces.groupBy(*keys).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("area"))


def extremum_flags(window, order: int, value: str = "value") -> dict[str, Column]:
    left, right = window.rowsBetween(-order, -1), window.rowsBetween(1, order)
    v = F.col(value)
    high = (v > F.max(value).over(left)) & (v > F.max(value).over(right))
    low = (v < F.min(value).over(left)) & (v < F.min(value).over(right))
    return {"is_max": F.coalesce(high, F.lit(False)), "is_min": F.coalesce(low, F.lit(False))}


def local_extrema(
    series: DataFrame, order: int, keys: list[str], value: str = "value", size: int = TILE
) -> DataFrame:
    """Flags `is_max` and `is_min`: strictly beyond every neighbour within `order` rows.

    The first and the last row have no neighbour on one side and never qualify.
    """
    tiled = tiles.with_halo(series, order, size=size)
    return tiles.core_rows(tiled.withColumns(extremum_flags(tiles.tile_window(keys), order, value)))


def kernel_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised smoothing weights for offsets -radius..radius."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def mirrored_places(radius: int) -> Column:
    """Places of the mirrored axis (… 1 0 | 0 1 … n-1 | n-1 n-2 …) that show row idx of n."""
    i, n = F.col("idx"), F.col("n")
    reach = F.floor(F.lit(radius) / (n * 2)) + 1
    turned = F.transform(F.sequence(-reach, reach), lambda t: F.array(i + t * n * 2, t * n * 2 - i - 1))
    shown = F.filter(F.flatten(turned), lambda p: (p >= -radius) & (p < n + radius))
    return F.when((i < radius) | (i >= n - radius), shown).otherwise(F.array(i))


def weighted_window(window, value: str, weights: list[float], first: int) -> Column:
    """Sum of weight * value over the rows at offsets first, first + 1, …"""
    total = F.lit(0.0)
    for step, weight in enumerate(weights):
        offset = first + step
        seen = F.col(value) if offset == 0 else F.lead(value, offset).over(window)
        total = total + seen * F.lit(weight)
    return total


def gaussian_smooth(
    series: DataFrame, sigma: float, keys: list[str], value: str = "value", out: str = "smooth", size: int = TILE,
) -> DataFrame:
    """Gaussian smoothing with mirrored ends."""
    weights = kernel_weights(sigma)
    radius = len(weights) // 2
    sized = tiles.attach(tiles.with_halo(series, size=size), tiles.series_facts(series, keys), keys, size)
    padded = sized.drop("tile", "core").withColumn("_pos", F.explode(mirrored_places(radius)))
    tiled = tiles.with_halo(padded, radius, idx="_pos", size=size)
    total = weighted_window(tiles.tile_window(keys, "_pos"), value, weights, -radius)
    smoothed = tiled.withColumn(out, total).filter(F.col("_pos") == F.col("idx"))
    return tiles.core_rows(smoothed).drop("_pos", "n")


def resample(
    series: DataFrame, length: int, keys: list[str], values: list[str], size: int = TILE,
    keep_if_equal: bool = False, together: str | None = None,
) -> DataFrame:
    """`length` samples at source position i*(n-1)/length; the last source sample is not reached.

    Each source row hands out the samples that lie between it and the next row, so there is
    no join from targets back to sources. With `keep_if_equal` a series that already has
    `length` rows passes unchanged. With `together`, one of the keys, series that are equal in it
    end in one task, and whoever takes them whole next needs no shuffle: source rows travel before
    they hand out their samples, those without a sample not at all. A key's series must be few.
    """
    facts = tiles.series_facts(series, keys)
    tiled = tiles.attach(tiles.with_halo(series.select(*keys, "idx", *values), 1, size=size), facts, keys, size)
    w = tiles.tile_window(keys)
    ahead = tiled.withColumns({f"_next_{v}": F.lead(v).over(w) for v in values}).filter("core")
    i, last, total = F.col("idx").cast("bigint"), F.col("n") - 1, F.lit(length).cast("bigint")

    def first_sample(at: Column) -> Column:
        # Smallest m with m * last >= at * length.
        return F.floor((at * total + last - 1) / last).cast("bigint")

    usual = F.struct(first_sample(i).alias("a"), F.least(first_sample(i + 1) - 1, total - 1).alias("b"))
    span = F.when(F.col("n") == 1, F.struct(F.lit(0).cast("bigint").alias("a"), (total - 1).alias("b"))).otherwise(usual)
    if keep_if_equal:
        span = F.when(F.col("n") == length, F.struct(i.alias("a"), i.alias("b"))).otherwise(span)
    out = ahead.withColumn("_span", span).filter(F.col("_span.a") <= F.col("_span.b"))
    if together is not None:
        # An explicit number: the rows are few but hand out many, so they must not be merged into few tasks by their byte size.
        out = out.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), together)
    out = out.withColumn("_m", F.explode(F.sequence(F.col("_span.a"), F.col("_span.b"))))
    frac = (F.col("_m") * last - i * total) / F.lit(float(length))
    if keep_if_equal:
        frac = F.when(F.col("n") == length, F.lit(0.0)).otherwise(frac)
    lerps = [
        F.when(frac == 0.0, F.col(v)).otherwise(F.col(v) + (F.col(f"_next_{v}") - F.col(v)) * frac).alias(v)
        for v in values
    ]
    return out.select(*keys, F.col("_m").alias("idx"), *lerps)


def resample_arc(points: DataFrame, length: int, keys: list[str] = CONTOUR, size: int = TILE) -> DataFrame:
    """`length` points at equal arc length along the curve, both ends included."""
    along = arc_length(points.select(*keys, "idx", "x", "y"), keys, size)
    facts = tiles.series_facts(along, keys, F.max("u").alias("_total"))
    tiled = tiles.attach(tiles.with_halo(along, 1, size=size), facts, keys, size)
    w = tiles.tile_window(keys)
    ahead = tiled.withColumns({f"_next_{c}": F.lead(c).over(w) for c in ("x", "y", "u")}).filter("core")
    steps = F.lit(length - 1).cast("bigint")
    is_last, flat = F.col("idx") == F.col("n") - 1, F.col("_total") == 0.0

    def first_target(u: Column) -> Column:
        return F.ceil(u / F.col("_total") * steps).cast("bigint")

    low = F.when(flat, F.when(is_last, F.lit(0).cast("bigint"))).otherwise(first_target(F.col("u")))
    high = F.when(is_last, steps).otherwise(
        F.when(flat, F.lit(-1).cast("bigint")).otherwise(F.least(first_target(F.col("_next_u")), steps) - 1)
    )
    out = (
        ahead.withColumns({"_low": low, "_high": high})
        .filter(F.col("_low") <= F.col("_high"))
        .withColumn("_m", F.explode(F.sequence("_low", "_high")))
    )
    gap = F.col("_next_u") - F.col("u")
    frac = F.when(is_last | (gap <= 0), F.lit(0.0)).otherwise(
        (F.col("_m") * F.col("_total") / steps - F.col("u")) / F.when(gap > 0, gap)
    )
    lerps = [(F.col(c) + F.coalesce((F.col(f"_next_{c}") - F.col(c)) * frac, F.lit(0.0))).alias(c) for c in ("x", "y")]
    return out.select(*keys, F.col("_m").alias("idx"), *lerps)


def dog_weights(steps: int, m: float, s: float) -> list[float]:
    """Wide minus narrow Gaussian density on `steps` places in [-2ms, 2ms] (not normalised)."""
    reach = 2.0 * m * s
    places = [(-reach + 2.0 * reach * j / (steps - 1)) if steps > 1 else -reach for j in range(steps)]

    def density(u: float, sd: float) -> float:
        return math.exp(-u * u / (2.0 * sd * sd)) / math.sqrt(2.0 * math.pi * sd * sd)

    return [density(u, m * s) - density(u, s) for u in places]


def dog_at(taps: np.ndarray, steps: int, m: float, s: float) -> np.ndarray:
    """`dog_weights` at the given taps only; a tap outside the kernel weighs nothing."""
    reach = 2.0 * m * s
    place = -reach + 2.0 * reach * taps / max(steps - 1, 1)

    def density(sd: float) -> np.ndarray:
        return np.exp(-place * place / (2.0 * sd * sd)) / math.sqrt(2.0 * math.pi * sd * sd)

    return np.where((taps >= 0) & (taps < steps), density(m * s) - density(s), 0.0)


def dog_response(
    points: DataFrame, steps: int, m: float, s: float, keys: list[str] = CONTOUR, size: int = TILE,
) -> DataFrame:
    """Squared difference-of-Gaussians response where the kernel fits entirely; idx starts at 0."""
    weights = dog_weights(steps, m, s)
    facts = tiles.series_facts(points, keys)
    tiled = tiles.attach(tiles.with_halo(points.select(*keys, "idx", "x", "y"), steps, size=size),
                         facts, keys, size, margin=steps)
    w = tiles.tile_window(keys)
    sums = {f"_{c}": weighted_window(w, c, weights, 0) for c in ("x", "y")}
    full = tiled.withColumns(sums).filter(F.col("core") & (F.col("idx") + steps <= F.col("n")))
    return full.select(*keys, "idx", (F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("response"))


def _partial_responses(batches):
    """Share of one source block in the responses of one block of places."""
    for frame in batches:
        parts = []
        for row in frame.itertuples(index=False):
            n, steps = int(row.n), int(row.n) // 2 + 1
            places = np.arange(row.out_from, min(row.out_to, n - steps + 1))
            sources = np.asarray(row.src_idx)
            if not len(places):
                continue
            taps = sources[None, :] - places[:, None]
            # Only the taps of this meeting: two blocks wide, however long the kernel.
            least = taps.min()
            used = dog_at(np.arange(least, taps.max() + 1), steps, 2.0, 1.0)[taps - least]
            parts.append(pd.DataFrame({
                "contour_id": row.contour_id, "idx": places,
                "x": used @ np.asarray(row.src_x), "y": used @ np.asarray(row.src_y),
            }))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def half_length_response(points: DataFrame, block: int = 512) -> DataFrame:
    """DoG response with a kernel half as long as the contour (m=2, s=1, n // 2 + 1 places).

    The kernel grows with the contour, so a window is no help. Blocks of sources meet the
    blocks of places they reach; each meeting gives one partial sum per place.
    """
    src = (
        points.select("contour_id", "idx", "x", "y").withColumn("_b", tiles.tile_of(F.col("idx"), block))
        .groupBy("contour_id", "_b")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("_p"))
        .select("contour_id", "_b", F.col("_p.idx").alias("src_idx"), F.col("_p.x").alias("src_x"),
                F.col("_p.y").alias("src_y"))
    )
    facts = tiles.series_facts(points, CONTOUR)
    steps = F.floor(F.col("n") / 2) + 1
    outs = facts.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       tiles.tile_of(F.col("n") - steps, block))))
    first, last = F.col("_o") * block, (F.col("_o") + 1) * block
    reach = outs.withColumn("out_from", first).withColumn("out_to", last).withColumn(
        "_b",
        F.explode(F.sequence(
            F.col("_o"),
            F.least(tiles.tile_of(last + steps, block), tiles.tile_of(F.col("n") - 1, block)),
        )),
    )
    met = src.hint("merge").join(reach, ["contour_id", "_b"]).drop("_b", "_o")
    key_type = points.schema["contour_id"].dataType.simpleString()
    parts = met.mapInPandas(_partial_responses, f"contour_id {key_type}, idx bigint, x double, y double")
    summed = parts.groupBy("contour_id", "idx").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return summed.select("contour_id", "idx", (F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("response"))


def edge_split(points: DataFrame, order: int = 250) -> DataFrame:
    """Where the leading edge ends: strongest local maximum of the half-length response, or null."""
    peaks = local_extrema(half_length_response(points), order, CONTOUR, "response").filter("is_max")
    best = peaks.groupBy("contour_id").agg(F.min(F.struct(-F.col("response"), F.col("idx").alias("k"))).alias("_best"))
    facts = tiles.series_facts(points, CONTOUR)
    half = F.floor((F.floor(F.col("n") / 2) + 1) / 2).cast("bigint")
    return facts.join(best, "contour_id", "left").select("contour_id", (F.col("_best.k") + half).alias("split_idx"))


def minmax_scaled(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Scale to [0, 1] inside each group; a constant group gives 0.

    The extremes come from a grouped aggregate (combined before the shuffle), so a large
    group is never gathered. The join picks its strategy from the size of the extremes.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span > 0, (F.col(value) - F.col("_low")) / F.when(span > 0, span)).otherwise(F.lit(0.0))
    return df.join(ends, keys).withColumn(out, scaled).drop("_low", "_high")



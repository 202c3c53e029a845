"""Arithmetic on `array<double>` columns and small numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def sum_of(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def with_norm(vec: Column) -> Column:
    return F.struct(vec.alias("vec"), norm(vec).alias("norm"))


def divided_by_norm(pair: Column) -> Column:
    return F.when(pair["norm"] > 0, F.transform(pair["vec"], lambda x: x / pair["norm"]))


def unit(vec: Column) -> Column:
    """Unit length; null for the zero vector.

    The one-element arrays bind the vector and its norm, so neither is evaluated per entry.
    """
    return F.get(F.transform(F.transform(F.array(vec), with_norm), divided_by_norm), F.lit(0))


def is_unit(vec: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(vec) - 1.0) < tolerance


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def rotate_about(x: Column, y: Column, cx: Column, cy: Column, theta: Column) -> tuple[Column, Column]:
    """Rotate (x, y) about (cx, cy) by minus theta."""
    dx, dy = x - cx, y - cy
    c, s = F.cos(theta), F.sin(theta)
    return dx * c + dy * s + cx, dy * c - dx * s + cy


def chord_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.atan2(y1 - y0, x1 - x0)


def gaussian_density(u: Column, s: Column) -> Column:
    return F.exp(-u * u / (s * s * 2.0)) / F.sqrt(s * s * (2.0 * math.pi))


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def exp_cost(scaled: Column) -> Column:
    """Cost of a cell whose strength was scaled to [0, 1] (min-max over its grid)."""
    return F.exp((F.lit(1.0) - scaled) * 5.0)


def hyp_cost(strength: Column, floor: float = 1e-4) -> Column:
    """`floor=1e-5` gives the older variant."""
    return F.lit(1.0) / clip(strength, floor, 1.0)


def resample_array(values: Column, length: int, first: Column | None = None, count: Column | None = None) -> Column:
    """`length` samples at i*(n-1)/length: the end of the slice is never reached."""
    start = F.lit(0) if first is None else first.cast("int")
    n = F.size(values) if count is None else count.cast("int")
    steps = F.sequence(F.lit(0), F.lit(length - 1))

    def sample(i: Column) -> Column:
        scaled = i * (n - 1)
        low = start + F.floor(scaled / F.lit(length)).cast("int")
        frac = F.pmod(scaled, F.lit(length)) / F.lit(float(length))
        a = F.get(values, low)
        return F.when(frac == 0.0, a).otherwise(a + (F.get(values, low + 1) - a) * frac)

    return F.transform(steps, sample)


# Polynomial coefficients of the spatial weights.
SPATIAL_COEFFICIENTS = {
    "bottlenose": (0.0960, 0.6537, 1.0000, 0.7943, 1.0000, 0.3584, 0.4492, 0.0000, 0.4157, 0.0626),
    "humpback": (0.0944, 0.5629, 0.7286, 0.6028, 0.0000, 0.0434, 0.6906, 0.7316, 0.4671, 0.0258),
}


def bernstein(t: Column, coefficients) -> Column:
    """Bernstein polynomial on [0, 1] with the given coefficients."""
    degree = len(coefficients) - 1
    total = F.lit(0.0)
    for j, c in enumerate(coefficients):
        weight = float(c) * math.comb(degree, j)
        total = total + F.lit(weight) * F.pow(t, F.lit(j)) * F.pow(F.lit(1.0) - t, F.lit(degree - j))
    return total


def tidy(value: Column, digits: int = 6) -> Column:
    """Round for reporting and drop the sign of zero."""
    return F.round(value, digits) + F.lit(0.0)

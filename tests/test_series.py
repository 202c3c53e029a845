import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from resight.operators import curvature, descriptors, series, tiles
from resight.params import DescriptorParams, GaussParams

KEY = ["contour_id"]


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(1)
    return {c: np.cumsum(rng.normal(size=(n, 2)), axis=0) for c, n in enumerate([1, 2, 5, 37, 100, 400])}


@pytest.fixture(scope="module")
def points(spark, curves):
    rows = [(c, i, float(x), float(y)) for c, xy in curves.items() for i, (x, y) in enumerate(xy)]
    frame = pd.DataFrame(rows, columns=["contour_id", "idx", "x", "y"])
    return spark.createDataFrame(frame).repartition(5).cache()


def by_contour(df, columns):
    frame = df.toPandas().sort_values(["contour_id", "idx"])
    return {c: g[columns].to_numpy() for c, g in frame.groupby("contour_id")}


def test_resample(points, curves):
    got = by_contour(series.resample(points, 64, KEY, ["x", "y"], size=16), ["x", "y"])
    for c, xy in curves.items():
        want = np.stack([brute.resample(xy[:, k], 64) for k in (0, 1)], 1)
        assert got[c].shape == want.shape and np.allclose(got[c], want)


def test_resample_keeps_equal_length(points, curves):
    got = by_contour(series.resample(points, 100, KEY, ["x"], size=16, keep_if_equal=True), ["x"])
    assert np.array_equal(got[4][:, 0], curves[4][:, 0])


def test_resample_arc(points, curves):
    got = by_contour(series.resample_arc(points, 64, size=16), ["x", "y"])
    for c, xy in curves.items():
        u = np.hstack((0, np.cumsum(np.linalg.norm(np.diff(xy, axis=0), axis=1))))
        at = np.linspace(0, u.max(), 64)
        assert np.allclose(got[c], np.stack([np.interp(at, u, xy[:, k]) for k in (0, 1)], 1))


def test_smooth_over_tile_borders(points, curves):
    got = by_contour(series.gaussian_smooth(points, 5.0, KEY, "x", size=32), ["smooth"])
    for c, xy in curves.items():
        assert np.allclose(got[c][:, 0], brute.smooth(xy[:, 0]))


def test_extrema_over_tile_borders(points, curves):
    got = by_contour(series.local_extrema(points, 3, KEY, "x", size=8), ["is_max", "is_min"])
    for c, xy in curves.items():
        high, low = brute.extrema(xy[:, 0], 3)
        assert got[c][:, 0].tolist() == high and got[c][:, 1].tolist() == low


def test_dog_response(points, curves):
    got = by_contour(series.dog_response(points, 9, 2, 1, size=16), ["response"])
    half = by_contour(series.half_length_response(points, block=64), ["response"])
    for c, xy in curves.items():
        if len(xy) >= 9:
            assert np.allclose(got[c][:, 0], brute.dog(xy, 9, 2, 1))
        else:
            assert c not in got
        assert np.allclose(half[c][:, 0], brute.dog(xy, len(xy) // 2 + 1, 2, 1))


def test_trim_and_orient(points, curves):
    got = by_contour(series.trim(points, 10, size=16), ["x"])
    for c, xy in curves.items():
        assert np.array_equal(got[c][:, 0], xy[10:-10, 0] if len(xy) > 20 else xy[:, 0])
    turned = by_contour(series.orient(points, series.wrong_direction("fluke"), size=16), ["x"])
    for c, xy in curves.items():
        assert np.array_equal(turned[c][:, 0], xy[::-1, 0] if xy[0, 0] > xy[-1, 0] else xy[:, 0])
    with pytest.raises(ValueError):
        series.wrong_direction("tail")


def test_running_total_and_trapezoid(points, curves):
    got = by_contour(series.arc_length(points, size=16), ["u"])
    area = {r.contour_id: r.area for r in series.trapezoid(points, size=16).collect()}
    for c, xy in curves.items():
        steps = np.linalg.norm(np.diff(xy, axis=0), axis=1)
        assert np.allclose(got[c][:, 0], np.hstack((0, np.cumsum(steps))))
        assert area[c] == pytest.approx(np.trapezoid(xy[:, 1], xy[:, 0]))


def test_no_window_holds_a_whole_series(spark):
    """Two thirds of the rows belong to one series; its tiles stay small."""
    hot = spark.range(20_000).select(F.lit(0).alias("contour_id"), F.col("id").alias("idx"), F.sin("id").alias("value"))
    cold = spark.range(10_000).select((F.col("id") % 100 + 1).cast("int").alias("contour_id"),
                                      F.floor(F.col("id") / 100).alias("idx"), F.cos("id").alias("value"))
    tiled = tiles.with_halo(hot.unionByName(cold), 20, size=512)
    assert tiled.groupBy("contour_id", "tile").count().agg(F.max("count")).first()[0] <= 512 + 40


def test_curvature(points, curves):
    radii = [1.5, 3.0, 6.0]
    frame = curvature.oriented_curvature(points, radii).toPandas()
    wide = frame.pivot(index=["contour_id", "idx"], columns="radius", values="value")
    for c, xy in curves.items():
        assert np.allclose(wide.loc[c].to_numpy(), brute.curvature(xy, radii), equal_nan=True)


def test_curvature_of_lone_and_equal_points(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 100.0, 0.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)]
    pts = spark.createDataFrame(rows, "contour_id int, idx int, x double, y double")
    got = {(r.contour_id, r.idx): r.value for r in curvature.oriented_curvature(pts, [1.0]).collect()}
    assert got[1, 0] == got[1, 1] == 0.5
    assert got[2, 0] is None and got[2, 1] is None


def test_descriptors(spark):
    rng = np.random.default_rng(2)
    raw = {(c, s): np.clip(0.5 + np.cumsum(rng.normal(size=n)) * 0.02, 0, 1)
           for c, n in enumerate([1, 2, 30, 200, 300, 64]) for s in (0.02, 0.04)}
    rows = [(c, s, i, float(v)) for (c, s), vs in raw.items() for i, v in enumerate(vs)]
    rows.append((99, 0.02, None, None))
    curv = spark.createDataFrame(rows, "contour_id long, scale double, idx long, value double").repartition(4)
    p = DescriptorParams(length=256, feat_dim=8, num_keypoints=6)
    out = descriptors.curvature_descriptors(curv, p)
    got = {}
    for r in out.collect():
        got.setdefault((r.contour_id, r.scale), {})[r.idx0, r.idx1] = np.array(r.vec)
    for key, v in raw.items():
        want = brute.descriptors(v, p)
        assert want.keys() == got.get(key, {}).keys()
        assert all(np.allclose(want[k], got[key][k]) for k in want)
    status = {r.contour_id: (r.success, r.n_desc) for r in descriptors.extraction_status(curv, out).collect()}
    assert status[99] == (False, 0) and status[3][0]


def test_gauss_descriptors(spark):
    rng = np.random.default_rng(3)
    raw = {c: np.cumsum(rng.normal(size=(n, 2)), axis=0) for c, n in enumerate([3, 30, 200, 128])}
    rows = [(c, i, float(x), float(y)) for c, xy in raw.items() for i, (x, y) in enumerate(xy)]
    pts = spark.createDataFrame(rows, "contour_id long, idx long, x double, y double").repartition(4)
    p = GaussParams(scales=((2, 1), (2, 2)), length=128, num_keypoints=6, feat_dim=8)
    frame = descriptors.gauss_descriptors(pts, p).toPandas()
    for c, xy in raw.items():
        want = brute.gauss_descriptors(xy, p)
        got = {(r.scale, r.idx0, r.idx1): np.array(r.vec) for r in frame[frame.contour_id == c].itertuples()}
        assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)


def test_partitioning_does_not_matter(points):
    one = curvature.oriented_curvature(points.coalesce(1), [3.0]).toPandas()
    many = curvature.oriented_curvature(points.repartition(13), [3.0]).toPandas()
    keys = ["contour_id", "idx", "radius"]
    a, b = (f.sort_values(keys).reset_index(drop=True) for f in (one, many))
    assert np.allclose(a["value"], b["value"], equal_nan=True)


def test_pairs_travel_without_the_columns_of_the_radii(spark):
    """Centres are copied to the cells their disc lies in, and a pair is dealt to its centre before anything is made of it."""
    rng = np.random.default_rng(3)
    side = np.arange(12) * 0.5  # many points at a distance of exactly one radius, and on the borders of cells
    xy = np.concatenate([np.array(np.meshgrid(side, side)).reshape(2, -1).T, rng.uniform(-3, 3, (60, 2))])
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("a", 900, None, 1.0), ("a", 901, float("nan"), 1.0)]
    points = spark.createDataFrame(rows, "contour_id string, idx long, x double, y double")
    for radius in (0.5, 0.25, 1.3):
        got = sorted((r.centre, r.idx) for r in curvature.neighbours_within(points, radius).collect())
        gap = ((xy[:, None] - xy[None]) ** 2)
        assert got == [(int(i), int(j)) for i, j in np.argwhere(gap[..., 0] + gap[..., 1] <= radius**2)]
    plan = curvature.oriented_curvature(points, [0.5, 1.0])._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression [contour_id"):]
    assert "_in0" not in dealt and dealt.count("explode(sequence(") == 2

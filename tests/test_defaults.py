"""The queries of default parameters against brute force, on the smallest tables."""

import brute
import numpy as np
import pytest

from checks import QUERIES
from checks import inputs as I
from checks.q_series import week_series
from conftest import SMALL
from resight.params import DescriptorParams, GaussParams, WarpParams, contour_preset


def found(frame, *keys):
    return {tuple(r[: len(keys)]): np.array(r[-1]) for r in frame[[*keys, "vec"]].itertuples(index=False)}


@pytest.fixture(scope="module")
def contours(tables):
    frame = I.contour(tables).toPandas().sort_values(["contour_id", "idx"])
    return {c: g[["x", "y"]].to_numpy() for c, g in frame.groupby("contour_id")}


def test_curvature(spark, contours):
    frame = QUERIES["j1_oriented_curvature_default"](spark, SMALL).toPandas()
    radii = contour_preset("fluke").radii
    wide = frame.pivot(index=["contour_id", "idx"], columns="radius", values="value")
    assert len(radii) == len(wide.columns) == 4
    for c, xy in contours.items():
        assert np.allclose(wide.loc[c].to_numpy(), brute.curvature(xy, radii), equal_nan=True)


def test_descriptors(spark, tables):
    got = found(QUERIES["j2_curvature_descriptors_default"](spark, SMALL).toPandas(), "contour_id", "scale", "idx0", "idx1")
    series = I.curvature(tables).toPandas().sort_values("idx").groupby(["contour_id", "scale"])["value"]
    want = {(*k, *at): vec for k, v in series for at, vec in brute.descriptors(v.to_numpy(), DescriptorParams()).items()}
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)
    assert {len(v) for v in got.values()} == {32}


def test_gauss_descriptors(spark, contours):
    got = found(QUERIES["j3_gauss_descriptors_default"](spark, SMALL).toPandas(), "contour_id", "scale", "idx0", "idx1")
    for c, xy in list(contours.items())[:1]:
        want = {(c, *k): v for k, v in brute.gauss_descriptors(xy, GaussParams()).items()}
        assert want.keys() == {k for k in got if k[0] == c} and all(np.allclose(want[k], got[k]) for k in want)


def test_uniform_gauss_descriptors(spark, contours):
    p = GaussParams(uniform=True)
    spots = {k * p.length // (p.num_keypoints - 1) for k in range(p.num_keypoints)}
    got = found(QUERIES["j3_uniform_keypoints"](spark, SMALL).toPandas(), "contour_id", "scale", "idx0", "idx1")
    for c, xy in list(contours.items())[:1]:
        mine = {k[1:]: v for k, v in got.items() if k[0] == c}
        assert {i for k in mine for i in k[1:]} == spots
        want = brute.gauss_descriptors(xy, p)
        assert want.keys() == mine.keys() and all(np.allclose(want[k], mine[k], atol=1e-5) for k in want)


def test_warping(spark, tables):
    p = WarpParams()
    queries, database = (df.toPandas() for df in week_series(tables, p.length))
    got = QUERIES["i1_warp_chi_square_default"](spark, SMALL).toPandas().set_index(["query_id", "target_id"])["score"]
    assert len(got) == queries.query_id.nunique() * database.target_id.nunique()
    shaped = lambda v: np.array(v).reshape(p.length, 2)
    for q in queries.head(5).itertuples():
        target = database.target_id.iloc[q.query_id % len(database)]
        want = min(brute.warp(shaped(q.values), shaped(d.values), np.ones(p.length), p.window, "chi_square")
                   for d in database[database.target_id == target].itertuples())
        assert got[q.query_id, target] == pytest.approx(want)


def test_from_points_to_scores(spark, contours):
    """The chain of curvature, descriptors, labels and evidence, beside the same steps on single contours."""
    p = DescriptorParams(length=128, feat_dim=8, num_keypoints=6)
    vecs = []
    for c, xy in sorted(contours.items()):
        wide = brute.curvature(xy, [2.0, 4.0])
        for scale, values in zip((2.0, 4.0), wide.T):
            vecs += [(scale, c, v) for v in brute.descriptors(values, p).values()]
    scores = {}
    for at in (2.0, 4.0):
        of, x = np.array([c for s, c, _ in vecs if s == at]), np.array([v for s, _, v in vecs if s == at])
        dist = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
        near = np.argsort(dist, axis=1, kind="stable")[:, :3]
        for q, places in enumerate(near):
            last, least = dist[q, places[2]], {}
            for k in places[:2]:
                least.setdefault(of[k] % 20, dist[q, k])
            for label, d in least.items():
                scores[of[q], label] = scores.get((of[q], label), 0.0) + d - last
    got = {(r.query_id, r.target_id): r.score for r in QUERIES["j4_contour_scores"](spark, SMALL).collect()}
    want = {k: s for k, s in scores.items() if s < -1e-5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_descriptors_leave_in_bounded_parts():
    """One batch of many curves gives hundreds of times its own size; no part holds it all."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from resight.operators import descriptors

    params, rng = GaussParams(length=256, num_keypoints=20, feat_dim=16), np.random.default_rng(3)
    spots = np.linspace(0, 256, 20).astype(int).tolist()
    kinds = [("contour_id", T.LongType()), ("scale", T.StringType()), ("idx0", T.LongType()), ("idx1", T.LongType()),
             ("vec", T.ArrayType(T.DoubleType()))]
    schema = to_arrow_schema(T.StructType([T.StructField(*k) for k in kinds]))
    many = 120
    curve = lambda: pa.array([rng.normal(size=256).tolist() for _ in range(many)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_pydict({"contour_id": pa.array(range(many)), "xs": curve(), "ys": curve(),
                                        "keypoints": pa.array([spots] * many, pa.list_(pa.int64()))})
    parts = [b.num_rows for b in descriptors._gauss_features(iter([batch]), schema, params)]
    one = 190 * 16
    assert sum(parts) == many * 190 * 4
    assert len(parts) > 1 and max(parts) * 16 <= descriptors.PART_VALUES + one

    schema = schema.set(1, pa.field("scale", pa.float64()))
    batch = pa.RecordBatch.from_pydict({"contour_id": pa.array(range(many)), "scale": pa.array([0.5] * many), "values": curve(),
                                        "keypoints": pa.array([spots[:-1]] * many, pa.list_(pa.int64()))})
    parts = [b.num_rows for b in descriptors._curvature_features(iter([batch]), schema, 64)]
    assert sum(parts) == many * 171
    assert len(parts) > 1 and max(parts) * 64 <= descriptors.PART_VALUES + 171 * 64


def test_series_travel_before_they_are_resampled(spark, tables):
    """No sample is shuffled (F4): source rows are dealt first, and all later steps find a contour's samples in one task."""
    from resight.operators import descriptors

    for made in (descriptors.series_keypoints(I.curvature(tables)), descriptors.gauss_descriptors(I.contour(tables))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        branches = plan.split("Generate explode(sequence(")
        assert len(branches) > 1 and "Exchange" not in branches[0]

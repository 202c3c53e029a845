"""Curvature, descriptors and warped distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_windows import smooth_sql
from checks.registry import query
from checks.sql_series import gauss_sql, warp_sql, week_series_sql
from resight.functions import vectors as V
from resight.functions.tables import register_tables
from resight.operators import curvature, descriptors, splits, warping
from resight.operators import series as S
from resight.params import DescriptorParams, GaussParams, SplitParams, WarpParams
from resight.session import cut

RADII = [20.0, 60.0]


@query("j1_oriented_curvature", f"""WITH {I.CONTOUR}, pr AS (SELECT a.contour_id, a.idx AS centre, b.idx, r.radius, a.x AS cx, a.y AS cy, b.x, b.y
  FROM pt a JOIN pt b USING (contour_id) CROSS JOIN (VALUES (20.0::DOUBLE), (60.0::DOUBLE)) r(radius) WHERE (b.x - a.x) ** 2 + (b.y - a.y) ** 2 <= radius * radius),
ch AS (SELECT contour_id, centre, radius, count(*) AS n, atan2(arg_max(y, idx) - arg_min(y, idx), arg_max(x, idx) - arg_min(x, idx)) AS th FROM pr GROUP BY 1, 2, 3),
tu AS (SELECT pr.*, n, (x - cx) * cos(th) + (y - cy) * sin(th) AS u, (y - cy) * cos(th) - (x - cx) * sin(th) + radius AS v FROM pr JOIN ch USING (contour_id, centre, radius)),
ar AS (SELECT *, (u - lag(u) OVER w) * (v + lag(v) OVER w) / 2 AS a FROM tu WINDOW w AS (PARTITION BY contour_id, centre, radius ORDER BY idx))
SELECT contour_id, centre AS idx, radius, round(CASE WHEN max(n) = 1 THEN 0.5 ELSE sum(a) / nullif((least(max(u), radius) - greatest(min(u), -radius)) * 2 * radius, 0) END, 6) + 0.0 AS value
FROM ar GROUP BY 1, 2, 3""")
def _(t):
    out = curvature.oriented_curvature(I.contour(t), RADII)
    return out.select("contour_id", "idx", "radius", V.tidy(F.col("value")).alias("value"))


SMALL = DescriptorParams(length=128, feat_dim=8, num_keypoints=6)

DESCRIPTORS = f"""{I.CURVATURE}, cnt AS (SELECT contour_id, count(*) AS n FROM pt GROUP BY 1),
tgt AS (SELECT contour_id, m, (m * (n - 1)) // 128 AS lo, ((m * (n - 1)) % 128) / 128.0 AS f FROM cnt, range(128) r(m)),
ev AS (SELECT t.contour_id, a.scale, m AS idx, a.value + coalesce(b.value - a.value, 0) * f AS value FROM tgt t
  JOIN curv a ON a.contour_id = t.contour_id AND a.idx = t.lo LEFT JOIN curv b ON b.contour_id = t.contour_id AND b.scale = a.scale AND b.idx = t.lo + 1),
{smooth_sql('ev', 'contour_id, scale', 'value')},
ex0 AS (SELECT *, smooth > max(smooth) OVER l AND smooth > max(smooth) OVER r AS mx, smooth < min(smooth) OVER l AND smooth < min(smooth) OVER r AS mn FROM sm
  WINDOW l AS (PARTITION BY contour_id, scale ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY contour_id, scale ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
ex AS (SELECT contour_id, scale, idx, abs(smooth - 0.5) AS strength, mx FROM ex0 WHERE mx OR mn),
fl AS (SELECT contour_id, scale, coalesce(min(idx) FILTER (mx), min(idx)) AS f, coalesce(max(idx) FILTER (NOT mx), max(idx)) AS l FROM ex GROUP BY 1, 2),
cd AS (SELECT e.contour_id, e.scale, idx, CASE WHEN (idx = f AND f <= 1) OR (idx = l AND l >= 126) THEN 1e300 ELSE strength END AS prio FROM ex e JOIN fl USING (contour_id, scale)
  UNION ALL SELECT contour_id, scale, 0, 1e300 FROM fl WHERE f > 1 UNION ALL SELECT contour_id, scale, 127, 1e300 FROM fl WHERE l < 126),
kp AS (SELECT contour_id, scale, idx FROM cd QUALIFY row_number() OVER (PARTITION BY contour_id, scale ORDER BY prio DESC, idx) <= 6),
pa AS (SELECT a.contour_id, a.scale, a.idx AS idx0, b.idx AS idx1, b.idx - a.idx + 1 AS cnt FROM kp a JOIN kp b ON a.contour_id = b.contour_id AND a.scale = b.scale AND a.idx < b.idx),
sl AS (SELECT p.*, q, idx0 + (q * (cnt - 1)) // 8 AS lo, ((q * (cnt - 1)) % 8) / 8.0 AS f FROM pa p, range(8) r(q)),
fe AS (SELECT s.contour_id, s.scale, idx0, idx1, q, a.value + coalesce(b.value - a.value, 0) * f AS raw FROM sl s JOIN ev a ON a.contour_id = s.contour_id AND a.scale = s.scale AND a.idx = s.lo
  LEFT JOIN ev b ON b.contour_id = s.contour_id AND b.scale = s.scale AND b.idx = s.lo + 1)"""


@query("j2_curvature_descriptors", f"""WITH {DESCRIPTORS} SELECT contour_id, round(scale, 6) AS scale, idx0, idx1, q AS dim,
round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY contour_id, scale, idx0, idx1)), 6) AS value FROM fe""")
def _(t):
    out = descriptors.curvature_descriptors(I.curvature(t), SMALL)
    wide = out.select("contour_id", "scale", "idx0", "idx1", F.posexplode("vec").alias("dim", "value"))
    return wide.withColumns({"dim": F.col("dim").cast("bigint"), "value": V.tidy(F.col("value"))})


@query("j3_uniform_keypoints")
def _(t):
    """Descriptors between evenly spaced places, at the default sizes; tested against brute force."""
    out = descriptors.gauss_descriptors(I.contour(t), GaussParams(uniform=True))
    return out.withColumn("vec", F.transform("vec", lambda e: V.tidy(e)))


@query("j2_extraction_status", f"""WITH {DESCRIPTORS}, nd AS (SELECT contour_id, count(DISTINCT (scale, idx0, idx1)) AS n FROM fe GROUP BY 1)
SELECT contour_id, n IS NOT NULL AS success, coalesce(n, 0)::BIGINT AS n_desc FROM (SELECT DISTINCT user_id AS contour_id FROM events) LEFT JOIN nd USING (contour_id)""")
def _(t):
    return descriptors.extraction_status(I.contour(t), descriptors.curvature_descriptors(I.curvature(t), SMALL))


@query("e8_keypoints", f"""WITH {DESCRIPTORS} SELECT contour_id, round(scale, 6) AS scale, idx FROM kp""")
def _(t):
    out = descriptors.series_keypoints(I.curvature(t), SMALL)
    return out.select("contour_id", "scale", F.explode("keypoints").alias("idx"))


@query("c9_keypoint_pairs", f"""WITH {DESCRIPTORS} SELECT contour_id, round(scale, 6) AS scale, idx0, idx1 FROM pa""")
def _(t):
    keyed = descriptors.series_keypoints(I.curvature(t), SMALL)
    return descriptors.keypoint_pairs(keyed).select("contour_id", "scale", "idx0", "idx1")


@query("c9_keypoint_pairs_sql", f"""WITH {DESCRIPTORS} SELECT contour_id, round(scale, 6) AS scale, idx0, idx1 FROM pa""")
def _(t):
    register_tables(t.spark)
    keyed = descriptors.series_keypoints(I.curvature(t), SMALL)
    return t.spark.sql("""SELECT * FROM keypoint_pairs(
        TABLE(SELECT contour_id, CAST(scale AS DOUBLE) AS scale, explode(keypoints) AS idx FROM {keyed}) PARTITION BY (contour_id, scale))""", keyed=keyed)


@query("c14_pair_slices", f"""WITH {DESCRIPTORS} SELECT p.contour_id, round(p.scale, 6) AS scale, idx0, idx1, count(*) AS n, round(sum(value), 6) AS total
FROM pa p JOIN ev e ON e.contour_id = p.contour_id AND e.scale = p.scale AND e.idx BETWEEN idx0 AND idx1 GROUP BY ALL""")
def _(t):
    pairs = descriptors.keypoint_pairs(descriptors.series_keypoints(I.curvature(t), SMALL))
    piece = descriptors.pair_slice(F.col("values"), F.col("idx0"), F.col("idx1"))
    return pairs.select("contour_id", "scale", "idx0", "idx1", F.size(piece).cast("bigint").alias("n"),
                        V.tidy(V.sum_of(piece)).alias("total"))


@query("j3_gauss_descriptors", gauss_sql())
def _(t):
    out = descriptors.gauss_descriptors(I.contour(t), GaussParams(length=256, num_keypoints=10))
    wide = out.select("contour_id", "scale", "idx0", "idx1", F.posexplode("vec").alias("dim", "value"))
    return wide.withColumns({"dim": F.col("dim").cast("bigint"), "value": V.tidy(F.col("value"))})


def week_series(t, length: int, num_db: int = 3):
    """Two-channel series per (user, week), split into queries and database by encounter."""
    pts = I.contour(t).select("contour_id", "idx", "x", "y", F.floor(F.col("x") / 7).cast("bigint").alias("week"))
    keys = ["contour_id", "week"]
    first = pts.groupBy(*keys).agg(F.min("idx").alias("_first"))
    local = pts.join(first, keys).select(*keys, (F.col("idx") - F.col("_first")).alias("idx"), (F.col("x") % 7).alias("x"), "y")
    scaled = S.minmax_scaled(S.minmax_scaled(local, keys, "y", "b"), keys, "x", "a")
    even = S.resample(scaled, length, keys, ["a", "b"])
    packed = cut(even.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "a", "b"))).alias("_v")).select(
        *keys, F.flatten(F.transform("_v", lambda v: F.array(v["a"], v["b"]))).alias("values")), "series")
    roles = splits.random_roles(
        packed.select(F.col("contour_id").cast("string").alias("individual"), F.col("week").cast("string").alias("encounter")),
        SplitParams(num_db=num_db))
    named = packed.select("contour_id", F.col("week").cast("string").alias("encounter"),
                          F.col("contour_id").cast("string").alias("individual"),
                          (F.col("contour_id") * 10 + F.col("week")).alias("series_id"), "values")
    both = cut(named.join(roles, ["individual", "encounter"]), "weeks")
    queries = both.filter("role = 'query'").select(F.col("series_id").alias("query_id"), "series_id", "values")
    database = both.filter("role = 'db'").select(F.col("contour_id").alias("target_id"), "series_id", "values")
    return queries, database


def _warped(t, cost):
    queries, database = week_series(t, 16)
    scores = warping.warping_scores(queries, database, WarpParams(window=4, length=16, cost=cost), 2)
    return scores.select("query_id", "target_id", V.tidy(F.col("score")).alias("score"))


WARPED = "WITH {series}, {best} SELECT query_id, target_id, round(score, 6) + 0.0 AS score FROM ws_best"


@query("i1_warp_chi_square", WARPED.format(series=week_series_sql(16), best=warp_sql(16, 4, "chi_square")))
def _(t):
    return _warped(t, "chi_square")


@query("i2_warp_euclidean", WARPED.format(series=week_series_sql(16), best=warp_sql(16, 4, "euclidean")))
def _(t):
    return _warped(t, "euclidean")


@query("c11_pruned_pairs_short", f"""WITH {week_series_sql(16)}, {warp_sql(16, 4, "chi_square")}
SELECT query_id, target_id, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score, target_id)::INTEGER AS rank
FROM ws_best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, target_id) <= 5""")
def _(t):
    queries, database = week_series(t, 16)
    found = warping.nearest_individuals(queries, database, 5, WarpParams(window=4, length=16), 2)
    return found.withColumn("score", V.tidy(F.col("score")))


@query("c11_pruned_pairs")
def _(t):
    queries, database = week_series(t, WarpParams().length)
    return warping.nearest_individuals(queries, database, 5, WarpParams(), 2)


@query("i3_distance_to_individual", f"""WITH {week_series_sql(16)}, {warp_sql(16, 4, "chi_square", "bottlenose")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, target_id) AS rank FROM ws_best)
SELECT q.query_id, q.query_id // 10 AS ind, coalesce(r.rank, -1) AS rank FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.target_id = q.query_id // 10""")
def _(t):
    from resight.operators import ranking

    queries, database = week_series(t, 16)
    scores = warping.warping_scores(queries, database, WarpParams(window=4, length=16), 2, "bottlenose")
    truth = queries.select("query_id", F.floor(F.col("query_id") / 10).cast("bigint").alias("ind")).distinct()
    return ranking.true_ranks(scores, truth, ["query_id"])

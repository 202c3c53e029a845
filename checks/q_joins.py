"""Joins (C2-C14) over points, vectors and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from resight.functions import vectors as V
from resight.operators import curvature, linking
from resight.operators import evidence as E
from resight.operators import neighbours as N
from resight.operators.stored_index import stored_neighbours, write_index
from resight.params import NeighbourParams
from resight.session import scratch_path


@query("c2_label_join", f"""WITH {I.VECTORS} SELECT v.vec_id, v.owner, v.scale, c_name AS name FROM vecs v JOIN customer ON c_custkey = v.owner""")
def _(t):
    names = t.customer.select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"))
    return I.vectors(t).join(names, "owner").select("vec_id", "owner", "scale", "name")


KNN = f"""{I.VECTORS}, d AS (SELECT a.owner AS query_id, a.scale, a.vec_id AS q_vec, b.vec_id AS d_vec, b.label AS target, b.owner AS d_owner,
  list_distance(a.vec, b.vec) AS dist FROM vecs a JOIN vecs b ON a.scale = b.scale),
nn AS (SELECT *, row_number() OVER (PARTITION BY q_vec ORDER BY dist, d_vec) AS place FROM d QUALIFY place <= 3)"""


def _neighbours(t, method, params=NeighbourParams()):
    v = I.vectors(t)
    return N.neighbours(v.withColumnRenamed("owner", "query_id"), v.withColumnRenamed("label", "target"), 3, method, params)


def _shown(found):
    return found.select("query_id", "scale", "q_vec", "d_vec", "target", V.tidy(F.col("dist")).alias("dist"))


KNN_SQL = f"""WITH {KNN} SELECT query_id, scale, q_vec, d_vec, target, round(dist, 6) + 0.0 AS dist FROM nn"""


@query("c3_knn_exact", KNN_SQL)
def _(t):
    return _shown(_neighbours(t, "exact", NeighbourParams(block_rows=64, db_block_rows=128, pivots=32)))


@query("c3_knn_stored", KNN_SQL)
def _(t):
    v, params = I.vectors(t), NeighbourParams(block_rows=64, db_block_rows=128)
    index = write_index(v.withColumnRenamed("label", "target"), scratch_path(t.spark, "index"), params)
    return _shown(stored_neighbours(v.withColumnRenamed("owner", "query_id"), index, 3, params))


@query("c3_knn_blocked", KNN_SQL)
def _(t):
    return _shown(_neighbours(t, "blocked"))


@query("c4_knn_lsh_recall")
def _(t):
    return N.recall(_neighbours(t, "lsh"), _neighbours(t, "blocked"))


@query("c4_knn_forest_recall", f"""WITH {KNN} SELECT scale, true AS good FROM nn GROUP BY scale""")
def _(t):
    """Whether at least nine of ten true neighbours are found, per scale."""
    found = N.recall(_neighbours(t, "forest"), _neighbours(t, "blocked"))
    return found.select("scale", (F.col("recall") >= 0.9).alias("good"))


@query("c5_radius_join", f"""WITH {I.CONTOUR} SELECT a.contour_id, a.idx AS centre, b.idx, round((b.x - a.x) ** 2 + (b.y - a.y) ** 2, 6) + 0.0 AS d2
FROM pt a JOIN pt b ON a.contour_id = b.contour_id AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 <= 400.0""")
def _(t):
    near = curvature.neighbours_within(I.contour(t), 20.0)
    return near.select("contour_id", "centre", "idx", V.tidy(F.col("d2")).alias("d2"))


QUADRANTS = f"""{I.ENDPOINTS}, pr AS (SELECT a.image_id, a.end_id AS src, a.contour_id AS ca, b.end_id AS dst, b.contour_id AS cb,
  b.i - a.i AS di, b.j - a.j AS dj, sqrt((b.i - a.i) ** 2 + (b.j - a.j) ** 2) AS dist
  FROM ep a JOIN ep b ON a.image_id = b.image_id),
qd AS (SELECT *, CASE WHEN di <= 0 AND dj > 0 THEN 1 WHEN di < 0 AND dj <= 0 THEN 2 WHEN di >= 0 AND dj < 0 THEN 3
  WHEN di > 0 AND dj >= 0 THEN 4 END AS quadrant FROM pr WHERE dist > 0 AND dist < 3.0),
nq AS (SELECT * FROM qd QUALIFY row_number() OVER (PARTITION BY image_id, src, quadrant ORDER BY dist, dst) = 1),
qn AS (SELECT image_id, src, dst, quadrant, -dist AS weight FROM nq WHERE ca <> cb)"""


@query("c6_quadrant_neighbours", f"""WITH {QUADRANTS} SELECT image_id, src, dst, quadrant, round(weight, 6) + 0.0 AS weight FROM qn""")
def _(t):
    near = linking.quadrant_neighbours(I.endpoints(t), 3.0)
    return near.select("image_id", "src", "dst", "quadrant", V.tidy(F.col("weight")).alias("weight"))


LINKS = f"""{I.PEAKS}, nb AS (SELECT a.*, b.i AS o_i, b.j AS o_j, b.pi AS o_pi, b.pj AS o_pj, b.ni AS o_ni, b.nj AS o_nj,
  sqrt((a.pi - b.pi) ** 2 + (a.pj - b.pj) ** 2) AS gap, (b.pi - a.pi) * a.nj - (b.pj - a.pj) * a.ni AS off FROM pk a JOIN pk b
  ON a.image_id = b.image_id AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND NOT (a.i = b.i AND a.j = b.j)),
dl AS (SELECT image_id, i, j, CASE WHEN off > 0 THEN 'fwd' ELSE 'bwd' END AS side, o_i AS t_i, o_j AS t_j FROM nb WHERE off <> 0
  QUALIFY row_number() OVER (PARTITION BY image_id, i, j, off > 0 ORDER BY gap, o_i, o_j) = 1),
ml AS (SELECT * FROM dl a WHERE EXISTS (SELECT 1 FROM dl b WHERE b.image_id = a.image_id AND b.i = a.t_i AND b.j = a.t_j
  AND b.t_i = a.i AND b.t_j = a.j))"""


@query("c7_half_plane_neighbours", f"""WITH {LINKS} SELECT image_id, i, j, side, t_i, t_j FROM dl""")
def _(t):
    return linking.directed_links(I.peaks(t))


@query("c8_mutual_links", f"""WITH {LINKS} SELECT image_id, i, j, side, t_i, t_j FROM ml""")
def _(t):
    return linking.mutual_links(linking.directed_links(I.peaks(t)))


@query("c13_collapse_peaks", f"""WITH {LINKS}, cl AS (SELECT image_id, i, j, count(CASE WHEN (o_i, o_j) < (i, j) THEN 1 END) AS smaller,
  count(CASE WHEN (o_i, o_j) > (i, j) THEN 1 END) AS n,
  sum(CASE WHEN (o_i, o_j) > (i, j) THEN o_pi END) AS spi, sum(CASE WHEN (o_i, o_j) > (i, j) THEN o_pj END) AS spj,
  sum(CASE WHEN (o_i, o_j) > (i, j) THEN o_ni * CASE WHEN ni * o_ni + nj * o_nj >= 0 THEN 1 ELSE -1 END END) AS sni,
  sum(CASE WHEN (o_i, o_j) > (i, j) THEN o_nj * CASE WHEN ni * o_ni + nj * o_nj >= 0 THEN 1 ELSE -1 END END) AS snj
  FROM nb WHERE gap < 0.7 GROUP BY 1, 2, 3),
mg AS (SELECT pk.*, coalesce(n, 0) AS n, (pk.pi + coalesce(spi, 0)) / (1 + coalesce(n, 0)) AS mpi, (pk.pj + coalesce(spj, 0)) / (1 + coalesce(n, 0)) AS mpj,
  (pk.ni + coalesce(sni, 0)) / (1 + coalesce(n, 0)) AS mni, (pk.nj + coalesce(snj, 0)) / (1 + coalesce(n, 0)) AS mnj
  FROM pk LEFT JOIN cl USING (image_id, i, j) WHERE coalesce(smaller, 0) = 0)
SELECT image_id, i, j, round(mpi, 6) + 0.0 AS pi, round(mpj, 6) + 0.0 AS pj,
  round(CASE WHEN n > 0 THEN mni / sqrt(mni ** 2 + mnj ** 2) ELSE ni END, 6) + 0.0 AS ni,
  round(CASE WHEN n > 0 THEN mnj / sqrt(mni ** 2 + mnj ** 2) ELSE nj END, 6) + 0.0 AS nj FROM mg""")
def _(t):
    out = linking.collapse_near_peaks(I.peaks(t), 0.7)
    return out.select("image_id", "i", "j", *[V.tidy(F.col(c)).alias(c) for c in ("pi", "pj", "ni", "nj")])


@query("c10_answer_pairs", """WITH s AS (SELECT l_orderkey AS qaid, l_partkey AS daid, -sum(l_discount) AS score FROM lineitem GROUP BY 1, 2),
p AS (SELECT DISTINCT o_orderkey AS qaid, l_partkey AS daid FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT o_orderkey, o_custkey FROM orders)
SELECT qaid, daid, round(coalesce(-score, 0), 6) + 0.0 AS score FROM p LEFT JOIN s USING (qaid, daid)""")
def _(t):
    scores = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("target_id")).agg(
        (-F.sum("l_discount")).alias("score"))
    bought = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("qaid"), F.col("l_partkey").alias("daid"))
    pairs = bought.union(t.orders.select("o_orderkey", "o_custkey")).distinct()
    return E.answer_pairs(pairs, scores).select("qaid", "daid", V.tidy(F.col("score")).alias("score"))


@query("c15_identity_overlap", """SELECT c_name AS name FROM customer WHERE c_nationkey < 13 INTERSECT SELECT c_name FROM customer WHERE c_nationkey >= 13""")
def _(t):
    from resight.operators.splits import shares_nothing

    named = t.customer.withColumnRenamed("c_name", "name")
    return shares_nothing(named.filter("c_nationkey < 13"), named.filter("c_nationkey >= 13"), "name")

"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_joins import KNN, LINKS
from checks.registry import query
from resight.functions import vectors as V
from resight.operators import descriptors, filters, grids, linking, ranking, splits
from resight.operators import evidence as E
from resight.operators import neighbours as N
from resight.operators import series as S

EVIDENCE = f"""{KNN}, nl AS (SELECT *, max(dist) OVER (PARTITION BY q_vec) AS last, max(place) OVER (PARTITION BY q_vec) AS got FROM nn),
ev AS (SELECT query_id, scale, q_vec, target AS target_id, min(dist) - max(last) AS score FROM nl WHERE place < got GROUP BY ALL)"""


def _evidence(t):
    v = I.vectors(t)
    found = N.neighbours(v.withColumnRenamed("owner", "query_id"), v.withColumnRenamed("label", "target"), 3)
    return E.evidence(found)


@query("d1_evidence", f"""WITH {EVIDENCE} SELECT query_id, scale, q_vec, target_id, round(score, 6) + 0.0 AS score FROM ev""")
def _(t):
    return _evidence(t).select("query_id", "scale", "q_vec", "target_id", V.tidy(F.col("score")).alias("score"))


@query("d2_scores_filled", f"""WITH {EVIDENCE}, s AS (SELECT query_id, target_id, sum(score) AS score FROM ev GROUP BY 1, 2)
SELECT q.query_id, c.target_id, round(coalesce(score, 0), 6) + 0.0 AS score FROM (SELECT DISTINCT owner AS query_id FROM vecs) q
CROSS JOIN (SELECT DISTINCT label AS target_id FROM vecs) c LEFT JOIN s ON s.query_id = q.query_id AND s.target_id = c.target_id""")
def _(t):
    v = I.vectors(t)
    filled = E.fill_classes(E.total_scores(_evidence(t)), v.select(F.col("owner").alias("query_id")),
                            v.select(F.col("label").alias("target_id")))
    return filled.select("query_id", "target_id", V.tidy(F.col("score")).alias("score"))


@query("d3_sum_over_scales", f"""WITH {EVIDENCE}, p AS (SELECT query_id, scale, target_id, sum(score) AS score FROM ev GROUP BY ALL)
SELECT query_id, target_id, count(*) AS scales, round(sum(score), 6) + 0.0 AS score FROM p GROUP BY 1, 2""")
def _(t):
    per_scale = E.scale_scores(_evidence(t))
    return per_scale.groupBy("query_id", "target_id").agg(F.count(F.lit(1)).alias("scales"), V.tidy(F.sum("score")).alias("score"))


@query("d4_name_scores", """SELECT l_orderkey AS qaid, p_brand AS dnid, round(sum(l_discount), 6) AS name_score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _(t):
    pairs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("qaid"), F.col("l_partkey").alias("daid"), F.col("p_brand").alias("dnid"),
        F.col("l_discount").alias("score"))
    return E.name_scores(pairs).select("qaid", "dnid", V.tidy(F.col("name_score")).alias("name_score"))


@query("d5_best_pair", """SELECT l_suppkey AS query_id, l_partkey % 50 AS target_id, round(min(l_extendedprice), 6) AS score FROM lineitem GROUP BY 1, 2""")
def _(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 50).alias("target_id"),
                              F.col("l_extendedprice").alias("score"))
    return E.best_pairs(pairs).select("query_id", "target_id", V.tidy(F.col("score")).alias("score"))


STATS = f"""{I.ROSTER}, ie AS (SELECT individual, encounter, count(*) AS n_images FROM roster GROUP BY 1, 2),
ne AS (SELECT individual, count(*) AS n_enc FROM ie GROUP BY 1 HAVING count(*) > 1), kp AS (SELECT * FROM ie JOIN ne USING (individual)),
hb AS (SELECT least(n_images, 18) AS bin, count(*) AS n FROM kp WHERE n_images BETWEEN 1 AND 19 GROUP BY 1),
he AS (SELECT least(n_enc, 18) AS bin, count(*) AS n FROM kp WHERE n_enc BETWEEN 1 AND 19 GROUP BY 1),
st AS (SELECT b.bin, coalesce(hb.n / (SELECT sum(n) FROM hb)::DOUBLE, 0) AS images_density,
  coalesce(he.n / (SELECT sum(n) FROM he)::DOUBLE, 0) AS encounters_density FROM range(1, 19) b(bin)
  LEFT JOIN hb ON hb.bin = b.bin LEFT JOIN he ON he.bin = b.bin)"""


@query("d6_encounter_statistics", f"""WITH {STATS} SELECT bin, round(images_density, 6) AS images_density, round(encounters_density, 6) AS encounters_density FROM st""")
def _(t):
    out = splits.encounter_statistics(I.roster(t))
    return out.select("bin", V.tidy(F.col("images_density")).alias("images_density"),
                      V.tidy(F.col("encounters_density")).alias("encounters_density"))


@query("d7_collect_vectors", f"""WITH {I.VECTORS} SELECT scale, count(*) AS n_vectors, count(DISTINCT owner) AS n_owners,
  count(CASE WHEN NOT abs(sqrt(list_sum(list_transform(vec, lambda v: v * v))) - 1) < 1e-5 THEN 1 END) AS n_not_unit FROM vecs GROUP BY 1""")
def _(t):
    return descriptors.collection_report(descriptors.require_unit(I.vectors(t)))


RANKS = """rk AS (SELECT l_suppkey % 5 AS run, l_orderkey AS enc, l_partkey AS ind, l_linenumber::BIGINT AS rank FROM lineitem)"""


def _ranks(t):
    return t.lineitem.select((F.col("l_suppkey") % 5).alias("run"), F.col("l_orderkey").alias("enc"),
                             F.col("l_partkey").alias("ind"), F.col("l_linenumber").cast("bigint").alias("rank"))


def _sizes(t):
    return t.region.select(F.col("r_regionkey").cast("bigint").alias("run"), (F.col("r_regionkey") + 7).cast("bigint").alias("n_individuals"))


CURVE = f"""{RANKS}, lv AS (SELECT r_regionkey::BIGINT AS run, k FROM region, range(1, 12) x(k) WHERE k <= r_regionkey + 7),
cu AS (SELECT lv.run, lv.k, 100.0 * count(CASE WHEN rank <= lv.k THEN 1 END) / count(*) AS accuracy FROM lv JOIN rk ON rk.run = lv.run
  WHERE rank > 0 GROUP BY 1, 2)"""


@query("d8_accuracy_curve", f"""WITH {CURVE} SELECT run, k, round(accuracy, 6) AS accuracy FROM cu""")
def _(t):
    return ranking.accuracy_curve(_ranks(t), _sizes(t)).select("run", "k", V.tidy(F.col("accuracy")).alias("accuracy"))


@query("d9_reciprocal_ranks", f"""WITH {RANKS} SELECT run, ind, count(*) AS num, round(avg(1.0 / rank), 6) AS mrr FROM rk GROUP BY 1, 2""")
def _(t):
    return ranking.reciprocal_ranks(_ranks(t)).select("run", "ind", "num", V.tidy(F.col("mrr")).alias("mrr"))


@query("d10_across_runs", f"""WITH {CURVE} SELECT k, round(avg(accuracy), 6) AS mean, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max,
  round(stddev_pop(accuracy), 6) AS std FROM cu GROUP BY 1""")
def _(t):
    out = ranking.across_runs(ranking.accuracy_curve(_ranks(t), _sizes(t)))
    return out.select("k", *[V.tidy(F.col(c)).alias(c) for c in ("mean", "min", "max", "std")])


@query("d12_minmax", """SELECT c_custkey, round(CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 0 END, 6) + 0.0 AS scaled FROM
  (SELECT c_custkey, c_acctbal, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_nationkey))""")
def _(t):
    out = S.minmax_scaled(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "scaled")
    return out.select("c_custkey", V.tidy(F.col("scaled")).alias("scaled"))


@query("d13_centroid", f"""WITH {I.GRID} SELECT grid_id, round_even(sum(w * row) / sum(w), 0)::BIGINT AS row, round_even(sum(w * col) / sum(w), 0)::BIGINT AS col
FROM grid GROUP BY 1""")
def _(t):
    return grids.weighted_centroid(I.grid(t))


@query("d14_success_ratio", """SELECT count(CASE WHEN quality = 1 THEN 1 END) AS n_success, count(*) AS n_total,
  round(count(CASE WHEN quality = 1 THEN 1 END) / count(*)::DOUBLE, 6) AS ratio FROM labels""")
def _(t):
    out = splits.success_report(t.labels, F.col("quality") == 1)
    return out.select("n_success", "n_total", V.tidy(F.col("ratio")).alias("ratio"))


@query("d15_distinct_ids", """SELECT DISTINCT o_custkey AS aid FROM orders""")
def _(t):
    return splits.distinct_ids(t.orders.withColumnRenamed("o_custkey", "aid"), "aid").orderBy("aid")


@query("d15_set_label", """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '-' ORDER BY o_orderpriority) AS label FROM orders GROUP BY 1""")
def _(t):
    return splits.set_label(t.orders, ["o_custkey"], "o_orderpriority")


def _box_sql(variant: str) -> str:
    x0 = "a0 - 0.1 * (a1 - a0)" if variant == "anchor" else "a0"
    return f"""WITH {I.PARTS}, ab AS (SELECT conv_id AS contour_id, x * part_w * 4 + part_x AS px, y * part_h * 4 + part_y AS py,
  r * part_w * 10 AS pr FROM seg JOIN part_box ON part_id = conv_id),
rb AS (SELECT contour_id, min(round_even(px, 0)::BIGINT - floor(pr)::BIGINT) - 1 AS a0, max(round_even(px, 0)::BIGINT + floor(pr)::BIGINT) + 1 AS a1,
  min(round_even(py, 0)::BIGINT - floor(pr)::BIGINT) - 1 AS b0, max(round_even(py, 0)::BIGINT + floor(pr)::BIGINT) + 1 AS b1 FROM ab GROUP BY 1),
m1 AS (SELECT *, {x0} AS x0, b0 - 0.1 * (b1 - b0) AS y0 FROM rb), m2 AS (SELECT *, a1 + 0.1 * (a1 - x0) AS x1, b1 + 0.1 * (b1 - y0) AS y1 FROM m1)
SELECT contour_id, round(least(greatest(x0, 0.0), 400.0)::DOUBLE, 6) + 0.0 AS x0, round(least(greatest(y0, 0.0), 300.0)::DOUBLE, 6) + 0.0 AS y0,
  round(least(greatest(x1, 0.0), 400.0)::DOUBLE, 6) + 0.0 AS x1, round(least(greatest(y1, 0.0), 300.0)::DOUBLE, 6) + 0.0 AS y1 FROM m2"""


def _box(t, variant):
    p = I.parts(t).select(F.col("part_id").alias("contour_id"), "part_x", "part_y", "part_w", "part_h", F.inline("segment"))
    pts = p.select(
        "contour_id", (F.col("x") * F.col("part_w") * 4 + F.col("part_x")).alias("x"),
        (F.col("y") * F.col("part_h") * 4 + F.col("part_y")).alias("y"), (F.col("r") * F.col("part_w") * 10).alias("r"))
    out = filters.contour_box(pts, 0.1, F.lit(400), F.lit(300), variant)
    return out.select("contour_id", *[V.tidy(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("d16_contour_box_coarse", _box_sql("coarse"))
def _(t):
    return _box(t, "coarse")


@query("d16_contour_box_anchor", _box_sql("anchor"))
def _(t):
    return _box(t, "anchor")


@query("d17_candidate_lists", """SELECT qaid, 0::BIGINT AS page, string_agg(daid::VARCHAR, ',' ORDER BY daid) AS daids, count(*) AS n
FROM (SELECT DISTINCT l_suppkey AS qaid, l_partkey AS daid FROM lineitem) GROUP BY 1""")
def _(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("qaid"), F.col("l_partkey").alias("daid")).distinct().withColumn("score", F.lit(0.0))
    out = E.candidate_lists(pairs)
    return out.select("qaid", "page", F.array_join(F.col("daids").cast("array<string>"), ",").alias("daids"),
                      F.size("daids").cast("bigint").alias("n"))


@query("d18_connected_chains", f"""WITH RECURSIVE {LINKS}, un AS (SELECT DISTINCT image_id, i, j, t_i, t_j FROM ml),
walk AS (SELECT image_id, i, j, i AS li, j AS lj FROM pk UNION SELECT w.image_id, w.i, w.j, u.t_i, u.t_j FROM walk w
  JOIN un u ON u.image_id = w.image_id AND u.i = w.li AND u.j = w.lj)
SELECT image_id, i, j, min((li, lj)).li AS chain_i, min((li, lj)).lj AS chain_j FROM
  (SELECT image_id, i, j, struct_pack(li := li, lj := lj) AS s, li, lj FROM walk) GROUP BY 1, 2, 3""".replace("min((li, lj)).li", "min(s).li").replace("min((li, lj)).lj", "min(s).lj"))
def _(t):
    pk = I.peaks(t)
    return linking.connected_chains(pk, linking.mutual_links(linking.directed_links(pk)))

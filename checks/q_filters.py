"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from resight.functions import boxes as X
from resight.functions import text
from resight.functions import vectors as V
from resight.operators import evidence as E
from resight.operators import filters as R
from resight.operators import series as S


@query("b1_flip_flag", f"""WITH {I.BOXES} SELECT aid, coalesce(lower(viewpoint) IN ('right', 'r', 'dorsal fin right', 'dorsal_fin_right'), false) AS flip FROM box""")
def _(t):
    return R.with_flip(I.boxes(t)).select("aid", "flip")


@query("b1b_contains_right", f"""WITH {I.BOXES} SELECT aid, coalesce(contains(viewpoint, 'right'), false) AS is_right FROM box""")
def _(t):
    return I.boxes(t).select("aid", text.contains_right(F.col("viewpoint")).alias("is_right"))


@query("b2_padded_crop", f"""WITH {I.BOXES}, g AS (SELECT *, trunc(w * 0.25)::BIGINT AS pw, trunc(h * 0.25)::BIGINT AS ph,
  x < 0 AND y < 0 AND w < 0 AND h < 0 AS whole FROM (SELECT aid, x, y, CASE WHEN aid % 50 = 0 THEN -w ELSE w END AS w,
  CASE WHEN aid % 50 = 0 THEN -h ELSE h END AS h, width, height FROM box))
SELECT aid, CASE WHEN whole THEN 0 ELSE greatest(0, x - pw) END AS x0, CASE WHEN whole THEN 0 ELSE greatest(0, y - ph) END AS y0,
  CASE WHEN whole THEN width ELSE least(width, x + w + pw) END AS x1,
  CASE WHEN whole THEN height ELSE least(height, y + h + ph) END AS y1 FROM g""")
def _(t):
    b = I.boxes(t)
    turned = b.withColumns({c: F.when(F.col("aid") % 50 == 0, -F.col(c)).otherwise(F.col(c)) for c in ("w", "h")})
    crop = X.padded_crop(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")], pad=0.25)
    return turned.select("aid", crop.alias("c")).select("aid", "c.x0", "c.y0", "c.x1", "c.y1")


@query("b3_mirror_box", f"""WITH {I.BOXES} SELECT aid, CASE WHEN coalesce(contains(viewpoint, 'right'), false) THEN width - (x + w) ELSE x END AS x, y, w, h FROM box""")
def _(t):
    right = text.contains_right(F.col("viewpoint"))
    return I.boxes(t).select("aid", X.mirrored_x(F.col("x"), F.col("w"), F.col("width"), right).alias("x"), "y", "w", "h")


@query("b4_mirror_contour", f"""WITH {I.PARTS} SELECT conv_id AS part_id, idx, round(1 - x, 6) + 0.0 AS x, round(y, 6) AS y, round(r, 6) AS r, flag FROM seg""")
def _(t):
    turned = I.parts(t).select("part_id", F.posexplode(R.mirrored_segment(F.col("segment"))).alias("idx", "p"))
    return turned.select("part_id", F.col("idx").cast("bigint").alias("idx"), V.tidy(F.col("p.x")).alias("x"),
                         V.tidy(F.col("p.y")).alias("y"), V.tidy(F.col("p.r")).alias("r"), F.col("p.flag").alias("flag"))


@query("b5_quality_filter", """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_linenumber % 4 + 1 AS g1, l_partkey % 3 + 1 AS g2,
  l_suppkey % 5 + 1 AS g3, l_orderkey % 3 + 1 AS g4, CAST(l_quantity AS BIGINT) % 4 + 1 AS g5,
  CASE l_returnflag WHEN 'A' THEN 'D1' WHEN 'N' THEN 'D2' ELSE 'D3' END AS rating FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM g WHERE g1 + g2 + g3 + g4 + g5 <= 11 AND rating IN ('D1', 'D2') AND year(l_shipdate) IN (1996, 1997, 1998)""")
def _(t):
    graded = t.lineitem.withColumns({
        "g1": F.col("l_linenumber") % 4 + 1, "g2": F.col("l_partkey") % 3 + 1, "g3": F.col("l_suppkey") % 5 + 1,
        "g4": F.col("l_orderkey") % 3 + 1, "g5": F.col("l_quantity").cast("bigint") % 4 + 1,
        "rating": F.when(F.col("l_returnflag") == "A", "D1").when(F.col("l_returnflag") == "N", "D2").otherwise("D3"),
    })
    kept = R.good_quality(graded, ["g1", "g2", "g3", "g4", "g5"], [1996, 1997, 1998], F.col("l_shipdate"))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query("b6_unknown_names", f"""WITH {I.PARTS} SELECT aid, CASE WHEN name = '____' THEN 'unknown-' || aid ELSE name END AS own_name, name <> '____' AS kept FROM annot""")
def _(t):
    a = I.annots(t)
    kept = R.known_names(a.withColumnRenamed("name", "individual")).select("aid", F.lit(True).alias("_k"))
    return a.join(kept, "aid", "left").select(
        "aid", text.own_name_if_unknown(F.col("name"), F.col("aid")).alias("own_name"),
        F.coalesce("_k", F.lit(False)).alias("kept"),
    )


@query("b7_valid_boxes", f"""WITH {I.PARTS} SELECT part_id FROM part_box JOIN annot ON aid = part_id
WHERE part_w > 5 AND part_h > 5 AND annot_w <> 0 AND annot_h <> 0 AND n_points > 0""")
def _(t):
    joined = I.parts(t).join(I.annots(t), "aid").withColumn("n_points", F.size("segment"))
    return R.valid_boxes(joined).select("part_id")


@query("b8_success_filter", f"""WITH {I.CONTOUR}, n AS (SELECT contour_id, count(*) AS n FROM pt GROUP BY 1) SELECT contour_id, n FROM n WHERE n >= 60""")
def _(t):
    status = I.contour(t).groupBy("contour_id").agg(F.count(F.lit(1)).alias("n")).withColumn("success", F.col("n") >= 60)
    return R.successes(status).select("contour_id", "n")


@query("b9_sparsify", """WITH s AS (SELECT l_orderkey AS query_id, l_partkey AS target_id, sum(0.05 - l_discount) AS score FROM lineitem GROUP BY 1, 2)
SELECT query_id, target_id, round(score, 6) + 0.0 AS score FROM s WHERE score < -1e-5
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = query_id AND o.o_custkey = target_id)""")
def _(t):
    scores = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("target_id")).agg(
        F.sum(0.05 - F.col("l_discount")).alias("score"))
    own = t.orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("target_id"))
    return E.sparsify(scores, -1e-5, own).select("query_id", "target_id", V.tidy(F.col("score")).alias("score"))


@query("b10_without_self", """SELECT l_suppkey AS qaid, l_partkey AS daid, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey <> l_partkey""")
def _(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("qaid"), F.col("l_partkey").alias("daid"), "l_orderkey", "l_linenumber")
    return E.without_self(pairs)


@query("b11_absolute_points", f"""WITH {I.PARTS} SELECT conv_id AS part_id, idx, round(x * part_w + part_x, 6) + 0.0 AS x,
  round(y * part_h + part_y, 6) AS y, round(r * part_w / 2, 6) AS r, flag AS occluded FROM seg JOIN part_box ON part_id = conv_id""")
def _(t):
    p = I.parts(t).select("part_id", F.col("part_x").alias("x0"), F.col("part_y").alias("y0"), F.col("part_w").alias("w"),
                          F.col("part_h").alias("h"), "segment")
    out = R.absolute_points(p)
    return out.select("part_id", F.col("idx").cast("bigint").alias("idx"), V.tidy(F.col("x")).alias("x"),
                      V.tidy(F.col("y")).alias("y"), V.tidy(F.col("r")).alias("r"), "occluded")


@query("b12_train_validation", """SELECT doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'valid' END AS side FROM labels""")
def _(t):
    table = t.labels.select("doc_id", (F.col("quality") == 1).alias("is_train"))
    train = R.train_rows(table).select("doc_id", F.lit("train").alias("side"))
    return train.unionByName(R.validation_rows(table).select("doc_id", F.lit("valid").alias("side")))


@query("b13_trim", f"""WITH {I.CONTOUR}, n AS (SELECT contour_id, count(*) AS n FROM pt GROUP BY 1)
SELECT contour_id, CASE WHEN n > 60 THEN idx - 30 ELSE idx END AS idx, round(y, 6) AS y FROM pt JOIN n USING (contour_id)
WHERE n <= 60 OR (idx >= 30 AND idx < n - 30)""")
def _(t):
    return S.trim(I.contour(t), 30).select("contour_id", "idx", V.tidy(F.col("y")).alias("y"))


@query("b14_axis_swap", f"""WITH {I.CONTOUR} SELECT contour_id, idx, round(CASE WHEN contour_id % 2 = 0 THEN x ELSE y END, 6) + 0.0 AS x,
  round(CASE WHEN contour_id % 2 = 0 THEN y ELSE x END, 6) + 0.0 AS y FROM pt""")
def _(t):
    ij = I.contour(t).withColumnsRenamed({"x": "i", "y": "j"})
    out = S.to_xy(ij, F.col("contour_id") % 2 == 0)
    return out.select("contour_id", "idx", V.tidy(F.col("x")).alias("x"), V.tidy(F.col("y")).alias("y"))


@query("b15_clamp", f"""WITH {I.CONTOUR} SELECT contour_id, idx, trunc(least(greatest(x - 3, 0.0), 19.0))::INTEGER AS cx,
  trunc(least(greatest(y, 0.0), 99.0))::INTEGER AS cy FROM pt""")
def _(t):
    return I.contour(t).select("contour_id", "idx", X.clamp_to_frame(F.col("x") - 3, F.lit(20)).alias("cx"),
                               X.clamp_to_frame(F.col("y"), F.lit(100)).alias("cy"))


@query("b16_requested_queries", """SELECT l_orderkey AS query_id, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(t):
    results = t.lineitem.select(F.col("l_orderkey").alias("query_id"), "l_linenumber", "l_partkey")
    wanted = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("query_id"))
    return E.only_queries(results, wanted)


@query("b17_normalised_anchors", f"""WITH {I.CONTOUR}, e AS (SELECT contour_id, arg_min(x, idx) AS sx, arg_min(y, idx) AS sy, arg_max(x, idx) AS ex,
  arg_max(y, idx) AS ey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY 1)
SELECT contour_id, round((sx - x0) / nullif(x1 - x0, 0), 6) + 0.0 AS start_x, round((sy - y0) / nullif(y1 - y0, 0), 6) + 0.0 AS start_y,
  round((ex - x0) / nullif(x1 - x0, 0), 6) + 0.0 AS end_x, round((ey - y0) / nullif(y1 - y0, 0), 6) + 0.0 AS end_y FROM e""")
def _(t):
    pts = I.contour(t)
    box = pts.groupBy("contour_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    out = R.normalised_anchors(pts, box)
    return out.select("contour_id", *[V.tidy(F.col(c)).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")])

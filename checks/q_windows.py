"""Window functions, rankings and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from resight.functions import vectors as V
from resight.operators import grids, ranking, splits
from resight.operators import neighbours as N
from resight.operators import series as S
from resight.params import SplitParams

SCORES = """sc AS (SELECT l_suppkey AS query_id, l_partkey % 200 AS target_id, -sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"""


def _scores(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 200).alias("target_id")).agg(
        (-F.sum("l_quantity")).alias("score"))


TRUE_RANK = """WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, target_id) AS rank FROM sc)
SELECT s_suppkey AS query_id, s_suppkey * 7 % 230 AS ind, coalesce(rank, -1) AS rank FROM supplier LEFT JOIN r
  ON query_id = s_suppkey AND target_id = s_suppkey * 7 % 230"""


@query("e1_true_rank", TRUE_RANK.format(S=SCORES))
def _(t):
    truth = t.supplier.select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 7 % 230).alias("ind"))
    return ranking.true_ranks(_scores(t), truth, ["query_id"])


SPARSE = """sc AS (SELECT q.query_id, d.target_id, coalesce(s.score, 0) AS score FROM (SELECT s_suppkey AS query_id FROM supplier) q,
  (SELECT DISTINCT l_partkey AS target_id FROM lineitem) d LEFT JOIN (SELECT l_suppkey AS query_id, l_partkey AS target_id,
  -sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2) s
  ON s.query_id = q.query_id AND s.target_id = d.target_id)"""


@query("e1_true_rank_sparse", TRUE_RANK.format(S=SPARSE))
def _(t):
    scores = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("target_id")).agg(
        (-F.sum("l_quantity")).alias("score"))
    truth = t.supplier.select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 7 % 230).alias("ind"))
    database = t.lineitem.select(F.col("l_partkey").alias("target_id"))
    return ranking.true_ranks(scores, truth, ["query_id"], database)


@query("e1_true_rank_positive", f"""WITH s AS ({{P}}), db AS (SELECT DISTINCT l_partkey % 200 AS target_id FROM lineitem),
tr AS (SELECT s_suppkey AS query_id, s_suppkey * 7 % 230 AS ind FROM supplier),
full_s AS (SELECT q.query_id, d.target_id, coalesce(s.score, 0) AS score FROM tr q CROSS JOIN db d
  LEFT JOIN s ON s.query_id = q.query_id AND s.target_id = d.target_id),
own AS (SELECT tr.query_id, tr.ind, f.score FROM tr LEFT JOIN full_s f ON f.query_id = tr.query_id AND f.target_id = tr.ind)
SELECT o.query_id, o.ind, (CASE WHEN o.score IS NULL THEN -1 ELSE 1 + (SELECT count(*) FROM full_s f
  WHERE f.query_id = o.query_id AND (f.score < o.score OR (f.score = o.score AND f.target_id < o.ind))) END)::BIGINT AS rank
FROM own o""".replace("{P}", "SELECT l_suppkey AS query_id, l_partkey % 200 AS target_id, sum(l_quantity) - 60 AS score FROM lineitem GROUP BY 1, 2"))
def _(t):
    scores = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 200).alias("target_id")).agg(
        (F.sum("l_quantity") - 60).alias("score"))
    truth = t.supplier.select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 7 % 230).alias("ind"))
    database = t.lineitem.select((F.col("l_partkey") % 200).alias("target_id"))
    return ranking.true_ranks(scores, truth, ["query_id"], database)


def _scores_of(rows):
    return rows.groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 200).alias("target_id")).agg(
        (-F.sum("l_quantity")).alias("score"))


SPLIT = f"""{I.ROSTER}, en AS (SELECT DISTINCT run, individual, encounter FROM roster, range(2) r(run)),
pl AS (SELECT *, row_number() OVER (PARTITION BY run, individual ORDER BY md5('0|' || run || '|' || individual || '|' || encounter), encounter) AS place,
  count(*) OVER (PARTITION BY run, individual) AS n FROM en),
role AS (SELECT run, individual, encounter, CASE WHEN n = 1 OR place <= least(n - 1, 10) THEN 'db' ELSE 'query' END AS role FROM pl)"""
TWO_RUNS = SplitParams(num_db=10, runs=2)


@query("e2_random_split", f"""WITH {SPLIT} SELECT run::INTEGER AS run, individual, encounter, role FROM role""")
def _(t):
    return splits.random_roles(I.roster(t), TWO_RUNS)


@query("e3_largest_split", f"""WITH {I.ROSTER}, c AS (SELECT individual, encounter, count(*) AS n FROM roster GROUP BY 1, 2)
SELECT 0::INTEGER AS run, individual, encounter, CASE WHEN row_number() OVER (PARTITION BY individual ORDER BY n DESC, encounter) = 1 THEN 'db' ELSE 'query' END AS role FROM c""")
def _(t):
    return splits.largest_roles(I.roster(t), SplitParams(strategy="largest"))


@query("d11_split_statistics", f"""WITH {SPLIT}, rr AS (SELECT run, individual, encounter, role FROM roster JOIN role USING (individual, encounter)),
g AS (SELECT run, role, individual, '' AS e, count(*) AS n FROM rr WHERE role = 'db' GROUP BY ALL
  UNION ALL SELECT run, role, individual, encounter, count(*) FROM rr WHERE role = 'query' GROUP BY ALL)
SELECT run::INTEGER AS run, role, max(n) AS most, round(avg(n), 6) AS mean, min(n) AS fewest FROM g GROUP BY 1, 2""")
def _(t):
    out = splits.split_statistics(splits.split_db_query(I.roster(t), TWO_RUNS))
    return out.select("run", "role", "most", V.tidy(F.col("mean")).alias("mean"), "fewest")


@query("e4_trapezoid", f"""WITH {I.CONTOUR}, s AS (SELECT contour_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM pt
WINDOW w AS (PARTITION BY contour_id ORDER BY idx)) SELECT contour_id, round(coalesce(sum(a), 0), 6) + 0.0 AS area FROM s GROUP BY 1""")
def _(t):
    return S.trapezoid(I.contour(t)).select("contour_id", V.tidy(F.col("area")).alias("area"))


@query("e5_arc_length", f"""WITH {I.CONTOUR}, s AS (SELECT contour_id, idx, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM pt
WINDOW w AS (PARTITION BY contour_id ORDER BY idx)) SELECT contour_id, idx, round(sum(d) OVER (PARTITION BY contour_id ORDER BY idx), 6) AS u FROM s""")
def _(t):
    return S.arc_length(I.contour(t)).select("contour_id", "idx", V.tidy(F.col("u")).alias("u"))


@query("e6_local_extrema", f"""WITH {I.CONTOUR} SELECT contour_id, idx, coalesce(y > max(y) OVER l AND y > max(y) OVER r, false) AS is_max,
  coalesce(y < min(y) OVER l AND y < min(y) OVER r, false) AS is_min FROM pt WINDOW l AS (PARTITION BY contour_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY contour_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def _(t):
    return S.local_extrema(I.contour(t), 3, ["contour_id"], "y").select("contour_id", "idx", "is_max", "is_min")


def smooth_sql(source: str, keys: str, value: str) -> str:
    """Gaussian smoothing with mirrored ends over rows (keys, idx, value) of `source`."""
    join = " AND ".join(f"s.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    return f"""kern AS (SELECT o, exp(-0.5 * (o / 5.0) ** 2) / (SELECT sum(exp(-0.5 * (p / 5.0) ** 2)) FROM range(-20, 21) q(p)) AS wt FROM range(-20, 21) k(o)),
sn AS (SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL),
sp AS (SELECT {cols}, i.idx, wt, n.n, ((i.idx + o) % (2 * n.n) + 2 * n.n) % (2 * n.n) AS q FROM sn n, LATERAL (SELECT unnest(range(n.n)) AS idx) i, kern),
sm AS (SELECT {cols}, n.idx, sum(wt * s.{value}) AS smooth FROM sp n JOIN {source} s ON {join}
  AND s.idx = CASE WHEN q < n.n THEN q ELSE 2 * n.n - 1 - q END GROUP BY ALL)"""


@query("e7_gaussian_smooth", f"""WITH {I.CONTOUR}, {smooth_sql('pt', 'contour_id', 'y')} SELECT contour_id, idx, round(smooth, 6) AS smooth FROM sm""")
def _(t):
    out = S.gaussian_smooth(I.contour(t), 5.0, ["contour_id"], "y")
    return out.select("contour_id", "idx", V.tidy(F.col("smooth")).alias("smooth"))


HALVES = """mid AS (SELECT grid_id, round_even(sum(w * row) / sum(w), 0)::BIGINT AS mr, round_even(sum(w * col) / sum(w), 0)::BIGINT AS mc, max(col) AS last FROM grid GROUP BY 1),
hv AS (SELECT g.grid_id, row, col, w, CASE WHEN col < mc THEN 'lead' ELSE 'trail' END AS half, last FROM grid g JOIN mid USING (grid_id) {W}),
dc AS (SELECT * FROM (SELECT *, max(w) OVER r AS rm, max(w) OVER c AS cm, min(row) OVER p AS r0, max(row) OVER p AS r1, min(col) OVER p AS c0, max(col) OVER p AS c1
  FROM hv WINDOW r AS (PARTITION BY grid_id, half, row), c AS (PARTITION BY grid_id, half, col), p AS (PARTITION BY grid_id, half))
  WHERE w = rm AND w = cm AND row > r0 AND row < r1 AND col > c0 AND col < c1)"""


@query("e9_dominant_cells", f"""WITH {I.GRID}, {HALVES.format(W='')} SELECT grid_id, half, row, col, round(w, 6) AS w FROM dc""")
def _(t):
    g = I.grid(t)
    mid = grids.weighted_centroid(g).select("grid_id", F.col("col").alias("mc"))
    halves = g.join(mid, "grid_id").withColumn("half", F.when(F.col("col") < F.col("mc"), "lead").otherwise("trail"))
    out = grids.dominant_cells(halves.select("grid_id", "half", "row", "col", "w"), ["grid_id", "half"])
    return out.select("grid_id", "half", "row", "col", V.tidy(F.col("w")).alias("w"))


def _ends_sql(where: str, lead: str, trail: str) -> str:
    return f"""WITH {I.GRID}, {HALVES.format(W=where)},
st AS (SELECT * FROM dc WHERE half = 'lead' QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY {lead}, row, col) = 1),
en AS (SELECT * FROM dc WHERE half = 'trail' QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY {trail}, row, col) = 1)
SELECT m.grid_id, coalesce(st.row, -1) AS start_row, coalesce(st.col, -1) AS start_col, coalesce(en.row, -1) AS end_row, coalesce(en.col, -1) AS end_col FROM mid m LEFT JOIN st USING (grid_id) LEFT JOIN en USING (grid_id)"""


@query("e9_end_cells_dorsal", _ends_sql("WHERE row >= mr", "col", "-col"))
def _(t):
    return grids.end_cells(I.grid(t), "dorsal").fillna(-1)


@query("e9_end_cells_fluke", _ends_sql("", "row ** 2 + col ** 2", "row ** 2 + (col - last) ** 2"))
def _(t):
    return grids.end_cells(I.grid(t), "fluke").fillna(-1)


@query("e10_direction", f"""WITH {I.CONTOUR}, e AS (SELECT contour_id, count(*) AS n, arg_min(y, idx) < arg_max(y, idx) AS rev FROM pt GROUP BY 1)
SELECT contour_id, CASE WHEN rev THEN n - 1 - idx ELSE idx END AS idx, round(y, 6) AS y, CASE WHEN rev THEN n - 1 - 5 ELSE 2 END AS b,
  CASE WHEN rev THEN n - 1 - 2 ELSE 5 END AS e FROM pt JOIN e USING (contour_id)""")
def _(t):
    pts = I.contour(t).withColumns({"b": F.lit(2).cast("bigint"), "e": F.lit(5).cast("bigint")})
    out = S.orient(pts, S.wrong_direction("left ear"), carry={"begin": "b", "end": "e"})
    return out.select("contour_id", "idx", V.tidy(F.col("y")).alias("y"), "b", "e")


def _dog_sql(steps: int, m: float, s: float) -> str:
    reach = 2 * m * s
    return f"""dk AS (SELECT j, {-reach} + {2 * reach} * j / {steps - 1}.0 AS u FROM range({steps}) k(j)),
dw AS (SELECT j, exp(-u * u / (2 * {m * s} * {m * s})) / sqrt(2 * pi() * {m * s} * {m * s}) - exp(-u * u / (2 * {s} * {s})) / sqrt(2 * pi() * {s} * {s}) AS wt FROM dk),
dn AS (SELECT contour_id, count(*) AS n FROM pt GROUP BY 1),
dr AS (SELECT p.contour_id, p.idx - j AS idx, sum(wt * x) ** 2 + sum(wt * y) ** 2 AS response FROM pt p JOIN dn USING (contour_id), dw
  WHERE p.idx - j >= 0 AND p.idx - j + {steps} <= n GROUP BY 1, 2)"""


@query("e11_dog_response", f"""WITH {I.CONTOUR}, {_dog_sql(9, 2.0, 1.0)} SELECT contour_id, idx, round(response, 6) AS response FROM dr""")
def _(t):
    return S.dog_response(I.contour(t), 9, 2.0, 1.0).select("contour_id", "idx", V.tidy(F.col("response")).alias("response"))


@query("e12_edge_split", f"""WITH {I.CONTOUR}, n AS (SELECT contour_id, count(*) AS n, count(*) // 2 + 1 AS steps FROM pt GROUP BY 1),
dw AS (SELECT contour_id, steps, n, j, -4.0 + 8.0 * j / (steps - 1) AS u FROM n, LATERAL (SELECT unnest(range(steps)) AS j) q),
kw AS (SELECT *, exp(-u * u / 8) / sqrt(2 * pi() * 4) - exp(-u * u / 2) / sqrt(2 * pi()) AS wt FROM dw),
dr AS (SELECT p.contour_id, p.idx - j AS idx, sum(wt * x) ** 2 + sum(wt * y) ** 2 AS response FROM pt p JOIN kw USING (contour_id)
  WHERE p.idx - j >= 0 AND p.idx - j + steps <= n GROUP BY 1, 2),
mx AS (SELECT *, response > max(response) OVER l AND response > max(response) OVER r AS is_max FROM dr
  WINDOW l AS (PARTITION BY contour_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY contour_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)),
b AS (SELECT contour_id, idx FROM mx WHERE is_max QUALIFY row_number() OVER (PARTITION BY contour_id ORDER BY response DESC, idx) = 1)
SELECT n.contour_id, coalesce(b.idx + steps // 2, -1) AS split_idx FROM n LEFT JOIN b USING (contour_id)""")
def _(t):
    return S.edge_split(I.contour(t), order=8).fillna(-1)


@query("e13_misidentifications", """WITH s AS (SELECT l_suppkey AS encounter, l_suppkey % 40 AS qind, l_orderkey AS q_image, l_partkey AS d_image, l_partkey % 40 AS dind,
  min(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY encounter, qind, q_image ORDER BY score, d_image) AS d_rank, min(score) OVER (PARTITION BY encounter, qind, q_image) AS best FROM s),
q AS (SELECT encounter, qind, q_image, row_number() OVER (PARTITION BY encounter, qind ORDER BY best, q_image) AS q_rank FROM (SELECT DISTINCT encounter, qind, q_image, best FROM r) QUALIFY q_rank <= 3),
tr AS (SELECT encounter, qind, q_image, min(d_rank) AS true_rank, arg_min(score, d_rank) AS true_score FROM r WHERE dind = qind GROUP BY 1, 2, 3)
SELECT encounter, qind, q_image, q_rank, d_rank, d_image, dind, round(score, 6) AS score, coalesce(true_rank, -1) AS true_rank, round(coalesce(true_score, -1), 6) AS true_score
FROM r JOIN q USING (encounter, qind, q_image) LEFT JOIN tr USING (encounter, qind, q_image) WHERE d_rank <= 5""")
def _(t):
    s = t.lineitem.groupBy(
        F.col("l_suppkey").alias("encounter"), (F.col("l_suppkey") % 40).alias("qind"), F.col("l_orderkey").alias("q_image"),
        F.col("l_partkey").alias("d_image"), (F.col("l_partkey") % 40).alias("dind"),
    ).agg(F.min("l_extendedprice").alias("score"))
    out = ranking.misidentifications(s, 3, 5).fillna(-1, ["true_rank", "true_score"])
    return out.withColumns({"score": V.tidy(F.col("score")), "true_score": V.tidy(F.col("true_score"))})


@query("f1_result_ranking", f"""WITH {SCORES} SELECT query_id, target_id, p_name AS name, score FROM sc JOIN part ON p_partkey = target_id""")
def _(t):
    names = t.part.select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("name"))
    return ranking.result_table(_scores(t), names).select("query_id", "target_id", "name", "score")


@query("f2_truncated_ranking", f"""WITH {SCORES} SELECT query_id, target_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, target_id) AS rank FROM sc QUALIFY rank <= 10""")
def _(t):
    return ranking.top_names(_scores(t), 10)


@query("f3_top_neighbours", """SELECT l_partkey AS q_vec, l_orderkey * 10 + l_linenumber AS d_vec, round(l_extendedprice, 6) AS dist FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber, l_suppkey) <= 3""")
def _(t):
    found = t.lineitem.select(
        F.lit(0).alias("query_id"), F.lit(0).alias("scale"), F.col("l_partkey").alias("q_vec"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("d_vec"), F.col("l_extendedprice").alias("dist"))
    return N.keep_nearest(found, 3).select("q_vec", "d_vec", V.tidy(F.col("dist")).alias("dist"))


@query("f4_newest_snapshot", """SELECT o_custkey AS tag, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id, epoch_us(max(o_orderdate)) AS created_us FROM orders GROUP BY 1""")
def _(t):
    from resight.functions.text import epoch_micros

    newest = t.orders.groupBy(F.col("o_custkey").alias("tag")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("s"))
    return newest.select("tag", F.col("s.o_orderkey").alias("snapshot_id"), epoch_micros(F.col("s.o_orderdate")).alias("created_us"))

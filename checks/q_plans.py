"""Composite operators a user calls (J4-J17) and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_aggregates import EVIDENCE, STATS
from checks.q_joins import QUADRANTS
from checks.q_series import week_series
from checks.q_sources import CATALOGUE, graded_roster
from checks.registry import query
from checks.sql_series import chains_sql, warp_sql, week_series_sql
from resight.functions import vectors as V
from resight.operators import linking, splits, warping
from resight.params import DescriptorParams, LnbnnParams, SnapshotParams, SplitParams, WarpParams
from resight.plans import derived, evaluation, report, scoring, snapshots, training
from resight.session import cut, scratch_path
from resight.sources import store

SPLIT_KNN = f"""{I.VECTORS}, {I.ROLES}, qv AS (SELECT v.* FROM vecs v JOIN roles USING (owner) WHERE role = 'query'),
dv AS (SELECT v.* FROM vecs v JOIN roles USING (owner) WHERE role = 'db'),
nn AS (SELECT a.owner AS query_id, a.vec_id AS q_vec, b.label AS target, list_distance(a.vec, b.vec) AS dist,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS place FROM qv a JOIN dv b ON a.scale = b.scale QUALIFY place <= 3),
nl AS (SELECT *, max(dist) OVER (PARTITION BY q_vec) AS last, max(place) OVER (PARTITION BY q_vec) AS got FROM nn),
ev AS (SELECT query_id, q_vec, target AS target_id, min(dist) - max(last) AS score FROM nl WHERE place < got GROUP BY ALL),
sc AS (SELECT query_id, target_id, sum(score) AS score FROM ev GROUP BY 1, 2 HAVING sum(score) < -1e-5)"""


def split_vectors(t):
    # A search reads its inputs several times; stored vectors are the usual case.
    both = cut(I.vectors(t).join(I.role_split(t), "owner"), "vectors")
    return both.filter("role = 'query'").drop("role"), both.filter("role = 'db'").drop("role")


def split_scores(t, **changes):
    queries, database = split_vectors(t)
    return scoring.lnbnn_scores(queries, database, LnbnnParams(**changes))


def _tidy_scores(df):
    return df.withColumn("score", V.tidy(F.col("score")))


@query("j4_lnbnn_scores", f"""WITH {SPLIT_KNN} SELECT query_id, target_id, round(score, 6) + 0.0 AS score FROM sc""")
def _(t):
    return _tidy_scores(split_scores(t))


@query("j4_lnbnn_scores_stored", f"""WITH {SPLIT_KNN} SELECT query_id, target_id, round(score, 6) + 0.0 AS score FROM sc""")
def _(t):
    """The index is published, found again through the catalogue and searched."""
    queries, database = split_vectors(t)
    folder, now = scratch_path(t.spark, "indexes"), F.lit(NOW).cast("timestamp_ntz")
    none = t.spark.createDataFrame([], "tag string, snapshot_id string, created timestamp_ntz")
    reach = (t.spark, none, "vectors", now, folder, "20011231", lambda place: scoring.index_vectors(database, place))
    place = snapshots.load_or_build_index(*reach)[1]
    listed = t.spark.range(1).select(F.lit("vectors").alias("tag"), F.lit(place).alias("snapshot_id"), now.alias("created"))
    index = snapshots.load_or_build_index(t.spark, listed, *reach[2:])[0]
    return _tidy_scores(scoring.lnbnn_scores(queries, index))


@query("j4_lnbnn_scores_whole", f"""WITH {EVIDENCE} SELECT query_id, target_id, round(sum(score), 6) + 0.0 AS score FROM ev GROUP BY 1, 2 HAVING sum(score) < -1e-5""")
def _(t):
    v = I.vectors(t)
    return _tidy_scores(scoring.lnbnn_scores(v, v))


@query("j4_contour_scores")
def _(t):
    """From points to scores; no SQL, as J1 to J3 have theirs one by one."""
    points = I.contour(t)
    user = F.col("contour_id")
    owners = points.select("contour_id").distinct().select("contour_id", user.alias("owner"), (user % 20).alias("label"))
    vecs = scoring.contour_vectors(points, owners, [2.0, 4.0], DescriptorParams(length=128, feat_dim=8, num_keypoints=6))
    return _tidy_scores(scoring.lnbnn_scores(vecs, vecs))


@query("j4_lnbnn_scores_annotation", f"""WITH {EVIDENCE}, ea AS (SELECT query_id, q_vec, d_owner AS target_id, min(dist) - max(last) AS score FROM nl WHERE place < got GROUP BY ALL)
SELECT query_id, target_id, round(sum(score), 6) + 0.0 AS score FROM ea WHERE query_id <> target_id GROUP BY 1, 2 HAVING sum(score) < -1e-5""")
def _(t):
    v = I.vectors(t)
    return _tidy_scores(scoring.lnbnn_scores(v, v, LnbnnParams(level="annotation")))


@query("j4_lnbnn_scores_lsh")
def _(t):
    return _tidy_scores(split_scores(t, method="lsh"))


PAIRS = f"""{EVIDENCE}, ea AS (SELECT query_id, q_vec, d_owner AS target_id, min(dist) - max(last) AS score FROM nl WHERE place < got GROUP BY ALL),
sa AS (SELECT query_id AS qaid, target_id AS daid, sum(score) AS score FROM ea WHERE query_id <> target_id GROUP BY 1, 2 HAVING sum(score) < -1e-5),
ask AS (SELECT a.vec_id AS qaid, b.vec_id AS daid FROM embeddings a JOIN embeddings b ON a.label = b.label),
ps AS (SELECT qaid, daid, coalesce(-score, 0) AS score FROM ask LEFT JOIN sa USING (qaid, daid))"""


def _pair_scores(t, names=None):
    """Pairs of the same label, asked against the whole collection; with the name of the candidate if there are names."""
    queries = t.embeddings.select(F.col("vec_id").alias("qaid"), F.col("label").alias("group"))
    members = queries.withColumnRenamed("qaid", "daid")
    if names is not None:
        members = members.join(names.select(F.col("aid").alias("daid"), "nid"), "daid")
    v = I.vectors(t)
    return scoring.pair_scores(scoring.PairGroups(queries, members), v, v)


@query("j5_pair_scores", f"""WITH {PAIRS} SELECT qaid, daid, round(score, 6) + 0.0 AS score FROM ps""")
def _(t):
    return _tidy_scores(_pair_scores(t))


@query("j6_match_results", f"""WITH {PAIRS}, vp AS (SELECT qaid, q.label % 4 AS qnid, daid, d.vec_id % 40 AS nid, score FROM ps JOIN embeddings q ON q.vec_id = qaid
  JOIN embeddings d ON d.vec_id = daid WHERE qaid <> daid)
SELECT qaid, qaid % 40 AS qnid, nid, round(sum(score), 6) + 0.0 AS name_score, min(b) AS best_daid, round(max(score), 6) + 0.0 AS best_score
FROM (SELECT *, first_value(daid) OVER (PARTITION BY qaid, nid ORDER BY score DESC, daid) AS b FROM vp) GROUP BY qaid, nid""")
def _(t):
    names = t.embeddings.select(F.col("vec_id").alias("aid"), (F.col("vec_id") % 40).alias("nid"))
    out = scoring.match_results(_pair_scores(t, names), names)
    return out.withColumns({c: V.tidy(F.col(c)) for c in ("name_score", "best_score")})


@query("j7_encounter_scores", f"""WITH {SPLIT_KNN}, enc AS (SELECT vec_id AS owner, label || '-' || (vec_id % 20) AS encounter FROM embeddings)
SELECT encounter, target_id, round(sum(score), 6) + 0.0 AS score FROM ev JOIN enc ON owner = query_id GROUP BY 1, 2 HAVING sum(score) < -1e-5""")
def _(t):
    queries, database = split_vectors(t)
    members = t.embeddings.select(
        F.col("vec_id").alias("obs_id"),
        F.concat(F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 20).cast("string")).alias("encounter"))
    return _tidy_scores(scoring.encounter_scores(members, queries, database))


def _evaluated(t, max_names=-1):
    """Scores, truth and database of two runs: sparse scores, a missing score is 0."""
    scores = split_scores(t).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), F.col("query_id").alias("enc"), "target_id",
                                    "score")
    scores = scores.withColumn("score", F.when(F.col("run") == 1, -F.lit(3.0) - F.col("score")).otherwise(F.col("score")))
    scores = cut(scores.withColumn("score", F.round("score", 9)), "scores")
    roles = I.role_split(t).join(t.embeddings.select(F.col("vec_id").alias("owner"), F.col("label").cast("bigint").alias("ind")), "owner")
    run = F.explode(F.array(F.lit(0), F.lit(1))).alias("run")
    truth = roles.filter("role = 'query'").select(run, F.col("owner").alias("enc"), "ind")
    database = roles.filter("role = 'db'").select(run, F.col("ind").alias("target_id")).distinct()
    return evaluation.evaluate(scores, truth, max_names, database)


EVAL = f"""{SPLIT_KNN}, db AS (SELECT DISTINCT r.run, label::BIGINT AS target_id FROM dv, range(2) r(run)),
tr AS (SELECT DISTINCT r.run, owner AS enc, label::BIGINT AS ind FROM qv, range(2) r(run)),
ss AS (SELECT r.run, query_id AS enc, target_id, round(CASE WHEN r.run = 1 THEN -3.0 - score ELSE score END, 9) AS score FROM sc, range(2) r(run)),
dense AS (SELECT tr.run, tr.enc, db.target_id, coalesce(score, 0) AS score FROM tr JOIN db USING (run) LEFT JOIN ss ON ss.run = tr.run AND ss.enc = tr.enc AND ss.target_id = db.target_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY run, enc ORDER BY score, target_id) AS place FROM dense),
rk AS (SELECT tr.run::INTEGER AS run, tr.enc, tr.ind, coalesce(place, -1) AS rank FROM tr LEFT JOIN ra ON ra.run = tr.run AND ra.enc = tr.enc AND ra.target_id = tr.ind),
nk AS (SELECT run, count(DISTINCT target_id) AS n FROM db GROUP BY 1),
tk AS (SELECT rk.run, k, 100.0 * count(CASE WHEN rank <= k THEN 1 END) / count(*) AS accuracy FROM rk JOIN nk USING (run), range(1, 1000) x(k) WHERE k <= n AND rank > 0 GROUP BY 1, 2)"""


@query("j9_evaluate_all", f"""WITH {EVAL} SELECT run, enc, ind, rank FROM rk""")
def _(t):
    return _evaluated(t, 3)["all"].select("run", "enc", "ind", "rank")


@query("j9_evaluate_rankings", f"""WITH {EVAL}, tp AS (SELECT run, enc, string_agg(target_id::VARCHAR, ',' ORDER BY place) AS names FROM ra WHERE place <= 3 GROUP BY 1, 2)
SELECT rk.run, rk.enc, coalesce(names, '') AS names FROM rk LEFT JOIN tp USING (run, enc)""")
def _(t):
    listed = F.array_join(F.col("ranking").cast("array<string>"), ",")
    return _evaluated(t, 3)["all"].select("run", "enc", F.coalesce(listed, F.lit("")).alias("names"))


@query("j9_evaluate_rankings_full", f"""WITH {EVAL} SELECT rk.run, rk.enc, rk.ind, rk.rank, ra.place AS position, ra.target_id AS ranking FROM rk LEFT JOIN ra USING (run, enc)""")
def _(t):
    return _evaluated(t)["all"]


@query("j9_evaluate_mrr", f"""WITH {EVAL} SELECT run, ind, count(*) AS num, round(avg(1.0 / rank), 6) AS mrr FROM rk WHERE rank > 0 GROUP BY 1, 2""")
def _(t):
    return _evaluated(t)["mrr"].withColumn("mrr", V.tidy(F.col("mrr")))


@query("j9_evaluate_topk", f"""WITH {EVAL} SELECT run, k, round(accuracy, 6) AS accuracy FROM tk""")
def _(t):
    return _evaluated(t)["topk"].withColumn("accuracy", V.tidy(F.col("accuracy")))


@query("a11_evaluation_sinks", f"""WITH {EVAL} SELECT k, round(avg(accuracy), 6) AS mean, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max,
round(stddev_pop(accuracy), 6) + 0.0 AS std FROM tk GROUP BY 1""")
def _(t):
    places = store.write_evaluation(_evaluated(t, 3), scratch_path(t.spark, "a11"))
    back = t.spark.read.parquet(places["agg"])
    return back.select("k", *[V.tidy(F.col(c)).alias(c) for c in ("mean", "min", "max", "std")])


@query("j10_split_db_query", f"""WITH {I.ROSTER}, en AS (SELECT DISTINCT individual, encounter FROM roster),
pl AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY md5('5|0|' || individual || '|' || encounter), encounter) AS place, count(*) OVER (PARTITION BY individual) AS n FROM en)
SELECT 0::INTEGER AS run, obs_id, individual, encounter, CASE WHEN n = 1 OR place <= least(n - 1, 15) THEN 'db' ELSE 'query' END AS role FROM roster JOIN pl USING (individual, encounter)""")
def _(t):
    return splits.split_db_query(I.roster(t), SplitParams(num_db=15, seed=5))


NOW = "2001-12-31 00:00:00"
SNAP = SnapshotParams(reuse_hours=24 * 400, expire_hours=24 * 2000)


@query("j11_latest_snapshot", f"""WITH a AS (SELECT o_orderkey AS snapshot_id, o_custkey AS tag, o_orderdate AS created, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) / 3600000000.0 AS age FROM orders),
n AS (SELECT tag, arg_max(snapshot_id, (created, snapshot_id)) AS snapshot_id FROM a WHERE age <= 9600 GROUP BY 1)
SELECT t.tag, coalesce(n.snapshot_id, -1) AS snapshot_id, CASE WHEN n.tag IS NULL THEN 'create' ELSE 'reuse' END AS action FROM (SELECT DISTINCT tag FROM a) t LEFT JOIN n USING (tag)
UNION ALL SELECT tag, snapshot_id, 'expire' FROM a WHERE age > 48000""")
def _(t):
    listed = t.orders.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("tag"), F.col("o_orderdate").alias("created"))
    return snapshots.latest_snapshot(listed, F.lit(NOW).cast("timestamp_ntz"), params=SNAP).fillna(-1, ["snapshot_id"])


@query("j12_delete_derived", """SELECT 'pairs' AS tbl, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND l_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
UNION ALL SELECT 'descriptors', count(*), sum(vec_id)::BIGINT FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)""")
def _(t):
    gone = t.supplier.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("aid"))
    left = snapshots.delete_derived(
        {"pairs": (t.lineitem.select("l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"]),
         "descriptors": (t.embeddings.select("vec_id"), ["vec_id"])}, gone)
    count = F.count(F.lit(1)).alias("n")
    return left["pairs"].agg(count, F.sum("l_partkey").alias("total")).select(F.lit("pairs").alias("tbl"), "n", "total").unionByName(
        left["descriptors"].agg(count, F.sum("vec_id").alias("total")).select(F.lit("descriptors").alias("tbl"), "n", "total"))


@query("j12_delete_stored", """SELECT count(*) AS n, sum(l_partkey)::BIGINT AS total FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND l_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)""")
def _(t):
    place = scratch_path(t.spark, "derived")
    derived.create_derived(t.lineitem.select("l_suppkey", "l_partkey"), place, ["l_suppkey", "l_partkey"])
    gone = t.supplier.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("aid"))
    derived.delete_stored(t.spark, place, ["l_suppkey", "l_partkey"], gone)
    return derived.read_derived(t.spark, place).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("total"))


TRAIN = f"""{I.PARTS}, nm AS (SELECT p.*, image, viewpoint, im_width, CASE WHEN name = '____' THEN 'unknown-' || part_id ELSE name END AS name FROM part_box p JOIN annot ON aid = part_id
  WHERE part_w > 5 AND part_h > 5 AND annot_w <> 0 AND annot_h <> 0),
sp AS (SELECT name, row_number() OVER (ORDER BY md5('0|' || name), name) - 1 < floor(count(*) OVER () * 0.8) AS is_train FROM (SELECT DISTINCT name FROM nm)),
fl AS (SELECT nm.*, coalesce(contains(viewpoint, 'right'), false) AS rt, is_train FROM nm JOIN sp USING (name)),
ms AS (SELECT f.*, s.idx, CASE WHEN rt THEN 1 - s.x ELSE s.x END AS sx, s.y, s.r, s.flag FROM fl f JOIN seg s ON s.conv_id = part_id),
dr AS (SELECT part_id, arg_min(sx, idx) > arg_max(sx, idx) AS rev FROM ms GROUP BY 1)
SELECT CASE WHEN rt THEN image || '-mirrored' ELSE image END AS image, name, part_id AS contour_id, CASE WHEN rev THEN n_points - 1 - idx ELSE idx END AS idx,
  round(sx * part_w + CASE WHEN rt THEN im_width - (part_x + part_w) ELSE part_x END, 6) + 0.0 AS x, round(y * part_h + part_y, 6) AS y, round(r * part_w / 2, 6) AS r, flag AS occluded, is_train
FROM ms JOIN dr USING (part_id)"""


@query("j13_training_table", f"WITH {TRAIN}")
def _(t):
    out = training.prepare_training_table(I.parts(t), I.annots(t))
    return out.withColumns({"idx": F.col("idx").cast("bigint"), **{c: V.tidy(F.col(c)) for c in ("x", "y", "r")}})


@query("j14_link_points", chains_sql())
def _(t):
    return linking.link_points(I.peaks(t), merge=True)


@query("j15_endpoint_links", f"""WITH {QUADRANTS}
SELECT image_id, src, dst, round(max(weight), 6) + 0.0 AS weight, 'gap' AS kind FROM qn GROUP BY 1, 2, 3
UNION ALL SELECT image_id, min(end_id) FILTER (place = 'start'), min(end_id) FILTER (place = 'end'), max(n_points)::DOUBLE, 'contour' FROM ep WHERE n_points > 1 GROUP BY image_id, contour_id""")
def _(t):
    return linking.endpoint_links(I.endpoints(t), 3.0).withColumn("weight", V.tidy(F.col("weight")))


@query("j16_incremental_refresh", f"""WITH {I.ROSTER} SELECT individual, encounter, count(*) AS n FROM roster r WHERE NOT EXISTS (SELECT 1 FROM roster o
WHERE o.individual = r.individual AND o.encounter = r.encounter AND o.side = 'error') GROUP BY 1, 2""")
def _(t):
    rows = I.roster(t)
    stored = rows.filter("side = 'error'").select("individual", "encounter")
    count = lambda new: new.groupBy("individual", "encounter").agg(F.count(F.lit(1)).alias("n"))
    return snapshots.incremental_refresh(rows, stored, ["individual", "encounter"], count)


@query("j17_catalogue_report", f"""WITH {STATS} SELECT bin, round(images_density, 6) AS images_density, round(encounters_density, 6) AS encounters_density,
(SELECT count(CASE WHEN quality = 1 THEN 1 END) FROM labels) AS n_success, (SELECT count(*) FROM labels) AS n_total FROM st""")
def _(t):
    out = report.catalogue_report(I.roster(t), t.labels.select((F.col("quality") == 1).alias("success")))
    return out.withColumns({c: V.tidy(F.col(c)) for c in ("images_density", "encounters_density")})


@query("j17_catalogue_individuals", f"""SELECT individual, count(*) AS n, count(DISTINCT encounter) AS n_encounters FROM
({CATALOGUE}) GROUP BY 1""")
def _(t):
    return graded_roster(t).groupBy("individual").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("encounter").alias("n_encounters"))


@query("j8_warping_scores_weighted", f"""WITH {week_series_sql(16)}, {warp_sql(16, 8, "chi_square", "humpback")}
SELECT query_id, target_id, round(score, 6) + 0.0 AS score FROM ws_best""")
def _(t):
    queries, database = week_series(t, 16)
    out = warping.warping_scores(queries, database, WarpParams(window=8, length=16), 2, "humpback")
    return _tidy_scores(out)

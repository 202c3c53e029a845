"""Scans, sources and sinks (A1-A12). Files are written by Spark from the whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from resight.functions import vectors as V
from resight.operators import splits
from resight.session import scratch_path
from resight.sources import rosters, store


@query("a1_csv_roster", f"""WITH {I.ROSTER} SELECT 'img/' || obs_id || '.jpg' AS impath, individual, encounter, side FROM roster""")
def _(t):
    place = scratch_path(t.spark, "a1")
    I.roster(t).select(
        F.concat(F.lit("img/"), F.col("obs_id").cast("string"), F.lit(".jpg")).alias("Filepath"),
        F.col("obs_id").alias("Other"), F.col("individual").alias("Individual"), F.col("encounter").alias("Encounter"),
        F.col("side").alias("Side"),
    ).write.option("header", True).csv(place)
    return rosters.full_roster(t.spark, place)


@query("a2_numbered_encounters", """SELECT event_id, CAST(user_id AS VARCHAR) AS individual,
  row_number() OVER (ORDER BY event_id) - 1 AS encounter, event_type AS side FROM events""")
def _(t):
    rows = t.events.select("event_id", F.col("user_id").cast("string").alias("individual"), F.col("event_type").alias("side"))
    return rosters.numbered_encounters(rows, "event_id", F.floor(F.col("event_id") / 1000))


PATHS = """p AS (SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang FROM pages),
path AS (SELECT '/' || host || '/' || CASE page_id % 4 WHEN 0 THEN lang || '-done' WHEN 1 THEN '.' || lang || '-DONE'
  WHEN 2 THEN lang || 'Done' ELSE lang END || '/' || page_id || '.jpg' AS path FROM p)"""


@query("a3_path_roster", f"""WITH {PATHS} SELECT path AS impath, split_part(path, '/', 2) AS individual, split_part(path, '/', 3) AS encounter,
  'Left' AS side FROM path WHERE lower(split_part(path, '/', 3)) LIKE '%done' AND split_part(path, '/', 3) NOT LIKE '.%'""")
def _(t):
    parts = F.split("url", "/")
    host, lang, k = parts[2], parts[3], F.col("page_id")
    folder = (
        F.when(k % 4 == 0, F.concat(lang, F.lit("-done"))).when(k % 4 == 1, F.concat(F.lit("."), lang, F.lit("-DONE")))
        .when(k % 4 == 2, F.concat(lang, F.lit("Done"))).otherwise(lang)
    )
    path = F.concat(F.lit("/"), host, F.lit("/"), folder, F.lit("/"), k.cast("string"), F.lit(".jpg"))
    return rosters.path_roster(t.pages.select(path.alias("path")))


CATALOGUE = """SELECT l_orderkey || '-' || l_linenumber || '.jpg' AS impath, c_name AS individual, o_orderkey || '-' || l_linenumber AS encounter,
  r_name AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN documents ON l_partkey = doc_id
  WHERE (l_linenumber % 4 + 1) + (p_size % 3 + 1) + (s_nationkey % 5 + 1) + (c_nationkey % 3 + 1) + (n_regionkey % 4 + 1) <= 11
    AND CASE lang WHEN 'en' THEN 'D1' WHEN 'fr' THEN 'D2' ELSE 'D3' END IN ('D1', 'D2') AND lang IS NOT NULL
    AND year(o_orderdate) IN (1996, 1997, 1998, 1999)"""


def catalogue(t):
    """Joined catalogue with five grades and a distinctiveness rating from the outer look-up."""
    ratings = t.documents.select(
        F.col("doc_id").alias("l_partkey"),
        F.when(F.col("lang") == "en", "D1").when(F.col("lang") == "fr", "D2").otherwise("D3").alias("rating"),
    )
    joined = rosters.star_join(t.lineitem, [
        (t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner"),
        (t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner"),
        (t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"),
        (t.region, F.col("n_regionkey") == F.col("r_regionkey"), "inner"),
        (t.part, F.col("l_partkey") == F.col("p_partkey"), "inner"),
        (t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "inner"),
        (ratings, ["l_partkey"], "left"),
    ])
    return joined.withColumns({
        "g1": F.col("l_linenumber") % 4 + 1, "g2": F.col("p_size") % 3 + 1, "g3": F.col("s_nationkey") % 5 + 1,
        "g4": F.col("c_nationkey") % 3 + 1, "g5": F.col("n_regionkey") % 4 + 1,
    })


def graded_roster(t):
    from resight.functions.text import compound_id
    from resight.operators.filters import good_quality

    kept = good_quality(catalogue(t), ["g1", "g2", "g3", "g4", "g5"], [1996, 1997, 1998, 1999], F.col("o_orderdate"))
    return kept.select(
        F.concat(compound_id(F.col("l_orderkey"), F.col("l_linenumber")), F.lit(".jpg")).alias("impath"),
        F.col("c_name").alias("individual"), compound_id(F.col("o_orderkey"), F.col("l_linenumber")).alias("encounter"),
        F.col("r_name").alias("side"),
    )


@query("a4_catalogue_scan", CATALOGUE)
def _(t):
    return graded_roster(t)


@query("a5_roster_sink", f"""WITH {I.ROSTER} SELECT 'img/' || obs_id || '.jpg' AS impath, individual, encounter, side FROM roster""")
def _(t):
    place = scratch_path(t.spark, "a5")
    path = F.concat(F.lit("img/"), F.col("obs_id").cast("string"), F.lit(".jpg"))
    rosters.write_roster(I.roster(t).withColumn("impath", path), place)
    return rosters.read_roster(t.spark, place)


def _stored(t, label):
    """Curvature with one failed contour in ten stored as a null row."""
    place = scratch_path(t.spark, label)
    failed = F.col("contour_id") % 10 == 3
    curv = I.curvature(t)
    good = curv.filter(~failed)
    null = curv.filter(failed).select("contour_id", "scale").distinct().select(
        "contour_id", F.lit(None).cast("bigint").alias("idx"), "scale", F.lit(None).cast("double").alias("value"))
    store.write_scales(good.select("contour_id", "idx", "scale", "value").unionByName(null), place)
    return place


@query("a6_scale_store", f"""WITH {I.CURVATURE} SELECT contour_id, printf('%.3f', scale) AS scale_key, count(CASE WHEN contour_id % 10 <> 3 THEN 1 END) AS n,
  contour_id % 10 = 3 AS failed FROM curv GROUP BY contour_id, scale""")
def _(t):
    stored = t.spark.read.parquet(_stored(t, "a6")).withColumn("scale_key", F.format_string("%.3f", F.col("scale_key").cast("double")))
    return stored.groupBy("contour_id", "scale_key").agg(F.count("value").alias("n"), (F.count("value") == 0).alias("failed"))


@query("a7_scale_load", f"""WITH {I.CURVATURE}, cnt AS (SELECT contour_id, count(*) AS n FROM pt GROUP BY 1),
ser AS (SELECT contour_id, idx, value FROM curv WHERE scale = 0.04 AND contour_id % 10 <> 3),
tgt AS (SELECT contour_id, n, m, (m * (n - 1)) // 60 AS lo, ((m * (n - 1)) % 60) / 60.0 AS f FROM cnt, range(60) r(m))
SELECT t.contour_id, '0.040' AS scale_key, m AS idx, round(CASE WHEN n = 60 THEN c.value ELSE a.value + coalesce(b.value - a.value, 0) * f END, 6) AS value
FROM tgt t JOIN ser a ON a.contour_id = t.contour_id AND a.idx = t.lo
LEFT JOIN ser b ON b.contour_id = t.contour_id AND b.idx = t.lo + 1 LEFT JOIN ser c ON c.contour_id = t.contour_id AND c.idx = t.m""")
def _(t):
    out = store.read_scales(t.spark, _stored(t, "a7"), [0.04], 60)
    return out.select("contour_id", "scale_key", "idx", V.tidy(F.col("value")).alias("value"))


@query("a8_attribute_lookup", """SELECT o_orderkey, o_custkey AS aid, c_name AS name, c_mktsegment AS viewpoint, c_nationkey AS nid, n_name AS species
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    asked = t.orders.select("o_orderkey", F.col("o_custkey").alias("aid"))
    known = t.customer.select(F.col("c_custkey").alias("aid"), F.col("c_name").alias("name"),
                              F.col("c_mktsegment").alias("viewpoint"), F.col("c_nationkey").alias("nid"))
    names = t.nation.select(F.col("n_nationkey").alias("nid"), F.col("n_name").alias("species"))
    return rosters.annotations(asked, known, names).select("o_orderkey", "aid", "name", "viewpoint", "nid", "species")


@query("a9_image_sets", """SELECT n_name AS set_name, c_custkey AS aid, c_mktsegment AS viewpoint FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def _(t):
    sets = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("set_name"), F.col("c_custkey").alias("aid"))
    wanted = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter(
        F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("n_name").alias("set_name"))
    known = t.customer.select(F.col("c_custkey").alias("aid"), F.col("c_mktsegment").alias("viewpoint"))
    return rosters.image_sets(sets, wanted, known).select("set_name", "aid", "viewpoint")


@query("a10_training_list", """SELECT 'img-' || doc_id AS image, 'n' || (doc_id % 20) AS name, doc_id::VARCHAR AS contour_id, quality = 1 AS is_train FROM labels""")
def _(t):
    place = scratch_path(t.spark, "a10")
    doc = F.col("doc_id")
    store.write_training_list(t.labels.select(
        F.concat(F.lit("img-"), doc.cast("string")).alias("image"), F.concat(F.lit("n"), (doc % 20).cast("string")).alias("name"),
        doc.alias("contour_id"), (F.col("quality") == 1).alias("is_train"),
    ), place)
    return store.read_training_list(t.spark, place)


@query("a12_roster_by_name", f"""WITH {I.ROSTER} SELECT obs_id, individual, encounter, side FROM roster""")
def _(t):
    readers = rosters.RosterReaders()
    readers.register("events", lambda: I.roster(t))
    readers.register("pages", lambda: rosters.path_roster(t.pages.select(F.col("url").alias("path"))))
    return readers.load("events")


@query("c1_star_join", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, r_name, lang FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN documents ON l_partkey = doc_id""")
def _(t):
    joined = rosters.star_join(t.lineitem, [
        (t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner"),
        (t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner"),
        (t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"),
        (t.region, F.col("n_regionkey") == F.col("r_regionkey"), "inner"),
        (t.part, F.col("l_partkey") == F.col("p_partkey"), "inner"),
        (t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "inner"),
        (t.documents, F.col("l_partkey") == F.col("doc_id"), "left"),
    ])
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_name", "r_name", "lang")


@query("g1_union_rosters", f"""WITH {I.ROSTER} SELECT 'e' || obs_id AS impath, individual, 'events:' || encounter AS encounter, side FROM roster
UNION ALL SELECT 'o' || o_orderkey, o_custkey::VARCHAR, 'orders:' || o_orderkey, 'Left' FROM orders
UNION ALL SELECT 'p' || page_id, page_id::VARCHAR, 'pages:' || page_id, 'Left' FROM pages""")
def _(t):
    left = F.lit("Left").alias("side")
    return rosters.union_rosters({
        "events": I.roster(t).withColumn("impath", F.concat(F.lit("e"), F.col("obs_id").cast("string"))),
        "orders": t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("impath"),
                                  F.col("o_custkey").cast("string").alias("individual"),
                                  F.col("o_orderkey").alias("encounter"), left),
        "pages": t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("impath"),
                                F.col("page_id").cast("string").alias("individual"), F.col("page_id").alias("encounter"), left),
    })


@query("c12_missing_inputs", """SELECT doc_id, s.scale::INTEGER AS scale FROM documents, range(1, 4) s(scale)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND s.scale <= 1 + l.quality + l.toxic)""")
def _(t):
    done = t.labels.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("quality") + F.col("toxic") + 1)).alias("scale"))
    wanted = F.array(*[F.lit(k) for k in (1, 2, 3)])
    return store.missing_scales(t.documents.select("doc_id"), done, wanted, "doc_id")


@query("c12_missing_outputs", """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return store.missing_inputs(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("g2_bag_union", """SELECT o_custkey AS aid, 'query' AS side FROM orders UNION ALL SELECT c_custkey, 'db' FROM customer""")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("aid"), F.lit("query").alias("side")).unionAll(
        t.customer.select(F.col("c_custkey").alias("aid"), F.lit("db").alias("side")))


@query("g3_split_overlap", """SELECT user_id::BIGINT AS individual FROM events INTERSECT SELECT o_custkey::BIGINT FROM orders""")
def _(t):
    side = lambda df, key: df.select(F.col(key).cast("bigint").alias("individual"))
    return splits.shares_nothing(side(t.events, "user_id"), side(t.orders, "o_custkey"), "individual")


@query("g4_scale_difference", """SELECT DISTINCT l_suppkey::BIGINT AS obs_id, l_linenumber::BIGINT AS scale FROM lineitem
EXCEPT SELECT s_suppkey::BIGINT, (s_nationkey % 7 + 1)::BIGINT FROM supplier""")
def _(t):
    wanted = t.lineitem.selectExpr("bigint(l_suppkey) AS obs_id", "bigint(l_linenumber) AS scale")
    done = t.supplier.selectExpr("bigint(s_suppkey)", "bigint(s_nationkey % 7 + 1)")
    return wanted.subtract(done)

"""Library inputs built from the driver tables, in Spark and (same names) as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Tables
from resight.functions.text import epoch_micros
from resight.functions.vectors import unit
from resight.operators.tiles import dense_index

START = 1704067200000000  # 2024-01-01 in microseconds
SCALES = 4


def roster(t: Tables) -> DataFrame:
    """Observations: individual = user, encounter = day, side = kind of event."""
    return t.events.select(
        F.col("event_id").alias("obs_id"), F.col("user_id").cast("string").alias("individual"),
        F.date_format("ts", "yyyy-MM-dd").alias("encounter"), F.col("event_type").alias("side"),
    )


ROSTER = """roster AS (SELECT event_id AS obs_id, CAST(user_id AS VARCHAR) AS individual,
  strftime(ts, '%Y-%m-%d') AS encounter, event_type AS side FROM events)"""


def contour(t: Tables) -> DataFrame:
    """One contour per user: x = days since the start, y = value."""
    rows = t.events.select(
        F.col("user_id").alias("contour_id"), "ts", "event_id",
        ((epoch_micros(F.col("ts")) - START) / F.lit(86400000000.0)).alias("x"), F.col("value").alias("y"),
    )
    return dense_index(rows, ["contour_id"], ["ts", "event_id"], F.date_trunc("hour", "ts")).drop("ts", "event_id")


CONTOUR = f"""pt AS (SELECT user_id AS contour_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (epoch_us(ts) - {START}) / 86400000000.0 AS x, value AS y FROM events)"""


def curvature(t: Tables) -> DataFrame:
    """Two value series per user on [0, 1)."""
    scaled = [F.struct(F.lit(s).alias("scale"), (F.col("y") / (F.col("y") + h)).alias("value"))
              for s, h in ((0.02, 50.0), (0.04, 150.0))]
    return contour(t).select("contour_id", "idx", F.inline(F.array(*scaled)))


CURVATURE = f"""{CONTOUR}, curv AS (SELECT contour_id, 0.02::DOUBLE AS scale, idx, y / (y + 50.0) AS value FROM pt
  UNION ALL SELECT contour_id, 0.04::DOUBLE, idx, y / (y + 150.0) FROM pt)"""


def vectors(t: Tables) -> DataFrame:
    """Four scales per embedding, one 16-wide slice each, of unit length; label = individual."""
    whole = F.col("embedding").cast("array<double>")
    pieces = F.explode(F.array(*[
        F.struct(F.lit(k).alias("scale"), F.slice(whole, 1 + 16 * k, 16).alias("raw")) for k in range(SCALES)
    ]))
    cut = t.embeddings.select(F.col("vec_id").alias("owner"), F.col("label").cast("bigint").alias("label"), pieces.alias("p"))
    return cut.select(
        "owner", F.col("p.scale").alias("scale"), (F.col("owner") * SCALES + F.col("p.scale")).alias("vec_id"),
        unit(F.col("p.raw")).alias("vec"), "label",
    )


VECTORS = """raw_piece AS (SELECT vec_id AS owner, label::BIGINT AS label, s.scale::INTEGER AS scale,
  list_slice(embedding::DOUBLE[], s.scale * 16 + 1, s.scale * 16 + 16) AS raw FROM embeddings, range(4) s(scale)),
vecs AS (SELECT owner, scale, owner * 4 + scale AS vec_id, label,
  list_transform(raw, lambda v: v / sqrt(list_sum(list_transform(raw, lambda w: w * w)))) AS vec FROM raw_piece)"""


def role_split(t: Tables, num_db: int = 40) -> DataFrame:
    """Embeddings as sightings of their label: up to `num_db` per label form the database."""
    from resight.operators.splits import random_roles
    from resight.params import SplitParams

    sightings = t.embeddings.select(F.col("label").cast("string").alias("individual"),
                                    F.col("vec_id").cast("string").alias("encounter"))
    roles = random_roles(sightings, SplitParams(num_db=num_db))
    return roles.select(F.col("encounter").cast("bigint").alias("owner"), "role")


ROLES = """role_key AS (SELECT vec_id AS owner, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('0|0|' || label::VARCHAR || '|' || vec_id::VARCHAR), vec_id::VARCHAR) AS place,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
roles AS (SELECT owner, CASE WHEN n = 1 OR place <= least(n - 1, 40) THEN 'db' ELSE 'query' END AS role FROM role_key)"""


def parts(t: Tables) -> DataFrame:
    """One part record per conversation: a segment ordered by turn, some running right to left."""
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    talk = t.conversations.join(last, "conv_id")
    along = F.when(F.col("_last") > 0, F.col("turn") / F.when(F.col("_last") > 0, F.col("_last"))).otherwise(F.lit(0.0))
    point = F.struct(
        F.when(F.col("conv_id") % 3 == 1, 1.0 - along).otherwise(along).alias("x"),
        (F.length("text") / F.lit(1000.0)).alias("y"),
        ((F.col("turn") % 3 + 1) / F.lit(100.0)).alias("r"),
        (F.col("role") == "assistant").alias("flag"),
    )
    grouped = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", point.alias("p")))).alias("_s"))
    c = F.col("conv_id")
    return grouped.select(
        c.alias("part_id"), c.alias("aid"), (c * 7 % 200).alias("part_x"), (c * 5 % 100).alias("part_y"),
        (c * 3 % 40 + 3).alias("part_w"), (c % 30 + 4).alias("part_h"), F.lit(0).alias("begin"),
        (F.size("_s") - 1).alias("end"), F.col("_s.p").alias("segment"),
    )


def annots(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    view = F.when(c % 4 == 0, "right").when(c % 4 == 1, "left").when(c % 4 == 2, "dorsal fin right")
    return t.conversations.select("conv_id").distinct().select(
        c.alias("aid"), F.concat(F.lit("img-"), c.cast("string")).alias("image"),
        F.when(c % 5 == 0, "____").otherwise(F.concat(F.lit("n"), (c % 20).cast("string"))).alias("name"),
        view.alias("viewpoint"), (c % 50).alias("annot_w"), (c % 40 + 1).alias("annot_h"),
        F.lit(400).cast("bigint").alias("im_width"),
    )


PARTS = """last AS (SELECT conv_id, max(turn) AS lt, count(*) AS n_points FROM conversations GROUP BY 1),
seg0 AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 AS idx, n_points,
  CASE WHEN lt > 0 THEN turn / lt::DOUBLE ELSE 0.0 END AS along, length(text) / 1000.0 AS y,
  (turn % 3 + 1) / 100.0 AS r, role = 'assistant' AS flag FROM conversations c JOIN last USING (conv_id)),
seg AS (SELECT conv_id, idx, n_points, CASE WHEN conv_id % 3 = 1 THEN 1.0 - along ELSE along END AS x, y, r, flag FROM seg0),
part_box AS (SELECT conv_id AS part_id, conv_id * 7 % 200 AS part_x, conv_id * 5 % 100 AS part_y,
  conv_id * 3 % 40 + 3 AS part_w, conv_id % 30 + 4 AS part_h, n_points FROM last),
annot AS (SELECT conv_id AS aid, 'img-' || conv_id AS image,
  CASE WHEN conv_id % 5 = 0 THEN '____' ELSE 'n' || (conv_id % 20) END AS name,
  CASE conv_id % 4 WHEN 0 THEN 'right' WHEN 1 THEN 'left' WHEN 2 THEN 'dorsal fin right' END AS viewpoint,
  conv_id % 50 AS annot_w, conv_id % 40 + 1 AS annot_h, 400 AS im_width FROM last)"""


def boxes(t: Tables) -> DataFrame:
    """Boxes in a 400 x 300 frame; some parts lie outside it."""
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("aid"), (k % 450 - 30).alias("x"), (k % 350 - 20).alias("y"), F.col("p_size").cast("bigint").alias("w"),
        F.floor(F.col("p_retailprice") / 20).cast("bigint").alias("h"),
        F.lit(400).cast("bigint").alias("width"), F.lit(300).cast("bigint").alias("height"),
        F.when(k % 6 == 0, "Right").when(k % 6 == 1, "dorsal_fin_right").when(k % 6 == 2, "upright")
        .when(k % 6 == 3, "R").when(k % 6 == 4, "left").alias("viewpoint"),
    )


BOXES = """box AS (SELECT p_partkey AS aid, p_partkey % 450 - 30 AS x, p_partkey % 350 - 20 AS y, p_size::BIGINT AS w,
  floor(p_retailprice / 20)::BIGINT AS h, 400 AS width, 300 AS height,
  CASE p_partkey % 6 WHEN 0 THEN 'Right' WHEN 1 THEN 'dorsal_fin_right' WHEN 2 THEN 'upright' WHEN 3 THEN 'R'
  WHEN 4 THEN 'left' END AS viewpoint FROM part)"""


def peaks(t: Tables) -> DataFrame:
    """Grid peaks: image = kind of event, cell = (hour, value band); normals from the event number."""
    e = t.events.withColumns({
        "i": (F.floor((epoch_micros(F.col("ts")) - START) / F.lit(3600000000)) % 720).cast("bigint"),
        "j": F.floor(F.col("value") / 4).cast("bigint"),
    })
    first = e.groupBy(F.col("event_type").alias("image_id"), "i", "j").agg(F.min("event_id").alias("k"))
    a = F.col("k") % 17 * F.lit(0.37)
    return first.select(
        "image_id", "i", "j", (F.col("i") + F.col("k") % 7 / F.lit(10.0) - 0.3).alias("pi"),
        (F.col("j") + F.col("k") % 5 / F.lit(10.0) - 0.2).alias("pj"), F.sin(a).alias("ni"), F.cos(a).alias("nj"),
    )


PEAKS = f"""cell AS (SELECT event_type AS image_id, ((epoch_us(ts) - {START}) // 3600000000) % 720 AS i,
  floor(value / 4)::BIGINT AS j, min(event_id) AS k FROM events GROUP BY 1, 2, 3),
pk AS (SELECT image_id, i, j, i + (k % 7) / 10.0 - 0.3 AS pi, j + (k % 5) / 10.0 - 0.2 AS pj,
  sin((k % 17) * 0.37) AS ni, cos((k % 17) * 0.37) AS nj FROM cell)"""


def endpoints(t: Tables) -> DataFrame:
    """First and last point of every (user, day) run; image = kind of the run's first event."""
    pts = contour(t).withColumn("day", F.floor("x").cast("bigint"))
    runs = pts.groupBy("contour_id", "day").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(F.struct("x", "y"), "idx").alias("a"),
        F.max_by(F.struct("x", "y"), "idx").alias("b"),
    ).withColumn("run", F.col("contour_id") * 100 + F.col("day"))
    ends = F.array(
        F.struct(F.lit("start").alias("place"), (F.col("run") * 2).alias("end_id"), F.col("a").alias("p")),
        F.struct(F.lit("end").alias("place"), (F.col("run") * 2 + 1).alias("end_id"), F.col("b").alias("p")),
    )
    every = runs.select((F.col("contour_id") % 20).alias("image_id"), F.col("run").alias("contour_id"), "n_points",
                        F.inline(ends))
    return every.filter((F.col("place") == "start") | (F.col("n_points") > 1)).select(
        "image_id", "contour_id", "end_id", F.col("p.x").alias("i"), (F.col("p.y") / 20.0).alias("j"), "place", "n_points"
    )


ENDPOINTS = f"""{CONTOUR}, run0 AS (SELECT contour_id, floor(x)::BIGINT AS day, count(*) AS n_points, min(idx) AS a, max(idx) AS b
  FROM pt GROUP BY 1, 2),
run AS (SELECT contour_id, contour_id * 100 + day AS run, n_points, a, b FROM run0),
ep AS (SELECT r.contour_id % 20 AS image_id, r.run AS contour_id, r.run * 2 AS end_id, p.x AS i, p.y / 20.0 AS j,
    'start' AS place, n_points FROM run r JOIN pt p ON p.contour_id = r.contour_id AND p.idx = r.a
  UNION ALL SELECT r.contour_id % 20, r.run, r.run * 2 + 1, p.x, p.y / 20.0, 'end', n_points
    FROM run r JOIN pt p ON p.contour_id = r.contour_id AND p.idx = r.b WHERE n_points > 1)"""


def grid(t: Tables) -> DataFrame:
    """One grid per user: row = 4-hour slot, column = day, w = sum of values there."""
    us = epoch_micros(F.col("ts")) - START
    return t.events.groupBy(
        F.col("user_id").alias("grid_id"), (F.floor(us / F.lit(14400000000)) % 6).cast("bigint").alias("row"),
        F.floor(us / F.lit(86400000000)).cast("bigint").alias("col"),
    ).agg(F.sum("value").alias("w"))


GRID = f"""grid AS (SELECT user_id AS grid_id, ((epoch_us(ts) - {START}) // 14400000000) % 6 AS row,
  (epoch_us(ts) - {START}) // 86400000000 AS col, sum(value) AS w FROM events GROUP BY 1, 2, 3)"""

"""Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from resight.functions import boxes, text
from resight.functions import vectors as V
from resight.operators import series as S


@query("s1_file_stem", """SELECT page_id, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(\\.*[^.]*(?:\\.[^.]+)*?)(?:\\.[^.]*)?$', 1) AS stem FROM pages""")
def _(t):
    return t.pages.select("page_id", text.file_stem(F.col("url")).alias("stem"))


@query("s2_compound_encounter", """SELECT o_orderkey, o_custkey || '-' || o_orderkey AS encounter FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", text.compound_id(F.col("o_custkey"), F.col("o_orderkey")).alias("encounter"))


@query("s3_scale_key", """SELECT l_orderkey, l_linenumber, l_partkey, printf('%.3f', l_discount) AS scale_key FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.scale_key(F.col("l_discount")).alias("scale_key"))


@query("s4_text_tests", """SELECT page_id, lower(url) LIKE '%done' OR lower(url) LIKE '%html' AS ends, url LIKE 'https%' AS starts,
  contains(url, 'spam') AS has, lower(url) AS low FROM pages""")
def _(t):
    low = F.lower("url")
    return t.pages.select(
        "page_id", (low.endswith("done") | low.endswith("html")).alias("ends"), F.col("url").startswith("https").alias("starts"),
        F.col("url").contains("spam").alias("has"), low.alias("low"),
    )


@query("s5_parse_dates", """WITH d AS (SELECT event_id, strftime(ts, '%m/%d/%y %H:%M:%S') AS s FROM events)
SELECT event_id, year(strptime(s, '%m/%d/%y %H:%M:%S')) AS taken_year,
  epoch(strptime(s, '%m/%d/%y %H:%M:%S'))::BIGINT AS seconds FROM d""")
def _(t):
    spelled = t.events.select("event_id", F.date_format("ts", text.CATALOGUE_DATE).alias("s"))
    taken = text.catalogue_timestamp(F.col("s"))
    return spelled.select(
        "event_id", F.year(taken).cast("bigint").alias("taken_year"),
        F.floor(text.epoch_micros(taken) / F.lit(1000000)).cast("bigint").alias("seconds"),
    )


@query("s6_age_hours", """SELECT o_orderkey, round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 3600000000.0, 6) + 0.0 AS age_hours,
  (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 3600000000.0 > 168 AS expired FROM orders""")
def _(t):
    age = text.hours_between(F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", V.tidy(age).alias("age_hours"), (age > 168).alias("expired"))


@query("s7_unit_vectors", f"""WITH {I.VECTORS} SELECT vec_id, round(sqrt(list_sum(list_transform(vec, lambda v: v * v))), 6) AS norm,
  round(vec[1], 6) + 0.0 AS first_value, round(vec[16], 6) + 0.0 AS last_value FROM vecs""")
def _(t):
    return I.vectors(t).select(
        "vec_id", V.tidy(V.norm(F.col("vec"))).alias("norm"), V.tidy(F.get("vec", F.lit(0))).alias("first_value"),
        V.tidy(F.get("vec", F.lit(15))).alias("last_value"),
    )


@query("s8_distance", f"""WITH {I.VECTORS} SELECT a.owner, a.scale AS scale_a, b.scale AS scale_b,
  round(list_distance(a.vec, b.vec), 6) AS dist FROM vecs a JOIN vecs b ON a.owner = b.owner AND b.scale = a.scale + 1""")
def _(t):
    v = I.vectors(t)
    a = v.select("owner", F.col("scale").alias("scale_a"), (F.col("scale") + 1).alias("scale_b"), F.col("vec").alias("va"))
    b = v.select("owner", F.col("scale").alias("scale_b"), F.col("vec").alias("vb"))
    return a.join(b, ["owner", "scale_b"]).select(
        "owner", "scale_a", "scale_b", V.tidy(V.distance(F.col("va"), F.col("vb"))).alias("dist")
    )


@query("s9_rotate", f"""WITH {I.CONTOUR} SELECT contour_id, idx,
  round((x - 15) * cos(idx * 0.1) + (y - 100) * sin(idx * 0.1) + 15, 6) + 0.0 AS rx,
  round((y - 100) * cos(idx * 0.1) - (x - 15) * sin(idx * 0.1) + 100, 6) + 0.0 AS ry FROM pt""")
def _(t):
    rx, ry = V.rotate_about(F.col("x"), F.col("y"), F.lit(15.0), F.lit(100.0), F.col("idx") * 0.1)
    return I.contour(t).select("contour_id", "idx", V.tidy(rx).alias("rx"), V.tidy(ry).alias("ry"))


@query("s10_chord_angle", f"""WITH {I.CONTOUR}, e AS (SELECT contour_id, arg_min(x, idx) AS x0, arg_min(y, idx) AS y0,
  arg_max(x, idx) AS x1, arg_max(y, idx) AS y1 FROM pt GROUP BY 1)
SELECT contour_id, round(atan2(y1 - y0, x1 - x0), 6) + 0.0 AS theta FROM e""")
def _(t):
    e = I.contour(t).groupBy("contour_id").agg(
        F.min_by("x", "idx").alias("x0"), F.min_by("y", "idx").alias("y0"),
        F.max_by("x", "idx").alias("x1"), F.max_by("y", "idx").alias("y1"),
    )
    theta = V.chord_angle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return e.select("contour_id", V.tidy(theta).alias("theta"))


@query("s11_cost_transforms", """WITH g AS (SELECT c_custkey, c_acctbal, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi
  FROM customer WINDOW w AS (PARTITION BY c_nationkey)),
s AS (SELECT c_custkey, CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 0 END AS c FROM g)
SELECT c_custkey, round(exp(5 * (1 - c)), 6) AS exp_cost, round(1 / least(greatest(c, 1e-4), 1), 6) AS hyp_cost,
  round(1 / least(greatest(c, 1e-5), 1), 6) AS old_cost FROM s""")
def _(t):
    scaled = S.minmax_scaled(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c")
    c = F.col("c")
    return scaled.select("c_custkey", V.tidy(V.exp_cost(c)).alias("exp_cost"), V.tidy(V.hyp_cost(c)).alias("hyp_cost"),
                         V.tidy(V.hyp_cost(c, 1e-5)).alias("old_cost"))


RESAMPLE = """cnt AS (SELECT contour_id, count(*) AS n FROM pt GROUP BY 1),
tgt AS (SELECT contour_id, n, m, (m * (n - 1)) // {L} AS lo, ((m * (n - 1)) % {L}) / {L}.0 AS f FROM cnt, range({L}) r(m)),
res AS (SELECT t.contour_id, m AS idx, a.x + coalesce(b.x - a.x, 0) * f AS x, a.y + coalesce(b.y - a.y, 0) * f AS y
  FROM tgt t JOIN pt a ON a.contour_id = t.contour_id AND a.idx = t.lo
  LEFT JOIN pt b ON b.contour_id = t.contour_id AND b.idx = t.lo + 1)"""


@query("s12_resample", f"""WITH {I.CONTOUR}, {RESAMPLE.format(L=100)}
SELECT contour_id, idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM res""")
def _(t):
    out = S.resample(I.contour(t), 100, ["contour_id"], ["x", "y"])
    return out.select("contour_id", "idx", V.tidy(F.col("x")).alias("x"), V.tidy(F.col("y")).alias("y"))


@query("s12_resample_array", """SELECT vec_id, m::INTEGER AS idx, round(a + (b - a) * f, 6) + 0.0 AS value FROM (SELECT vec_id, m, ((m * 63) % 25) / 25.0 AS f,
  embedding[(m * 63) // 25 + 1]::DOUBLE AS a, coalesce(embedding[(m * 63) // 25 + 2]::DOUBLE, 0) AS b FROM embeddings, range(25) r(m))""")
def _(t):
    out = V.resample_array(V.doubles(F.col("embedding")), 25)
    return t.embeddings.select("vec_id", F.posexplode(out).alias("idx", "value")).withColumn("value", V.tidy(F.col("value")))


@query("s13_resample_arc", f"""WITH {I.CONTOUR}, st AS (SELECT contour_id, idx, x, y,
  sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM pt WINDOW w AS (PARTITION BY contour_id ORDER BY idx)),
arc AS (SELECT contour_id, idx, x, y, sum(coalesce(d, 0)) OVER (PARTITION BY contour_id ORDER BY idx) AS u FROM st),
nx AS (SELECT *, lead(u) OVER w AS u1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(u) OVER (PARTITION BY contour_id) AS tot
  FROM arc WINDOW w AS (PARTITION BY contour_id ORDER BY idx)),
tg AS (SELECT DISTINCT contour_id, tot, m, m * tot / 63 AS s FROM nx, range(64) r(m)),
hit AS (SELECT t.contour_id, t.m, t.s, max(n.idx) AS idx FROM tg t JOIN nx n ON n.contour_id = t.contour_id
  AND (n.u <= t.s OR (t.m = 63)) GROUP BY ALL)
SELECT h.contour_id, h.m AS idx, round(n.x + coalesce((n.x1 - n.x) * (h.s - n.u) / nullif(n.u1 - n.u, 0), 0), 6) + 0.0 AS x,
  round(n.y + coalesce((n.y1 - n.y) * (h.s - n.u) / nullif(n.u1 - n.u, 0), 0), 6) + 0.0 AS y
FROM hit h JOIN nx n ON n.contour_id = h.contour_id AND n.idx = h.idx""")
def _(t):
    out = S.resample_arc(I.contour(t), 64)
    return out.select("contour_id", "idx", V.tidy(F.col("x")).alias("x"), V.tidy(F.col("y")).alias("y"))


@query("s14_gaussian_density", """SELECT l_orderkey, l_linenumber, l_partkey,
  round(exp(-u * u / (2 * s * s)) / sqrt(2 * pi() * s * s), 6) AS density
FROM (SELECT *, l_quantity / 10 - 2.5 AS u, l_tax * 10 + 1 AS s FROM lineitem)""")
def _(t):
    u, s = F.col("l_quantity") / 10 - 2.5, F.col("l_tax") * 10 + 1
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", V.tidy(V.gaussian_density(u, s)).alias("density"))


def _bernstein_sql(preset: str) -> str:
    import math

    terms = [f"{c} * {math.comb(9, j)} * pow(t, {j}) * pow(1 - t, {9 - j})"
             for j, c in enumerate(V.SPATIAL_COEFFICIENTS[preset])]
    return " + ".join(terms)


@query("s15_bernstein_weights", f"""SELECT l_orderkey, l_linenumber, l_partkey, round({_bernstein_sql('bottlenose')}, 6) AS w_bottlenose,
  round({_bernstein_sql('humpback')}, 6) AS w_humpback FROM (SELECT *, l_quantity / 50 AS t FROM lineitem)""")
def _(t):
    at = F.col("l_quantity") / 50
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[V.tidy(V.bernstein(at, c)).alias(f"w_{name}") for name, c in V.SPATIAL_COEFFICIENTS.items()],
    )


@query("s16_fingerprint", """SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS mark FROM customer""")
def _(t):
    return t.customer.select("c_custkey", text.fingerprint(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("mark"))


@query("s17_index_size", """SELECT c_nationkey, greatest(10, ceil(count(*) * 1000 / 2500.0))::BIGINT AS trees,
  (greatest(10, ceil(count(*) * 1000 / 2500.0)) * 2)::BIGINT AS search_k FROM customer GROUP BY 1""")
def _(t):
    counts = t.customer.groupBy("c_nationkey").agg((F.count(F.lit(1)) * 1000).alias("n"))
    return counts.select("c_nationkey", boxes.index_size(F.col("n")).alias("s")).select("c_nationkey", "s.trees", "s.search_k")

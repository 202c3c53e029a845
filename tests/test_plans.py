import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import inputs
from resight.operators import splits
from resight.params import SplitParams, contour_preset
from resight.operators import neighbours, stored_index
from resight.params import LnbnnParams, NeighbourParams
from resight.plans import derived, scoring, snapshots, training
from resight.session import scratch_path
from resight.sources import rosters, store
from resight.streaming.scores import stream_scores


def test_presets():
    assert contour_preset("fluke").radii == [s * 1152 for s in (0.02, 0.04, 0.06, 0.08)]
    assert contour_preset("ear").transpose and not contour_preset("dorsal").transpose


def test_split_rules(tables):
    roster = inputs.roster(tables)
    split = splits.split_db_query(roster, SplitParams(num_db=3, runs=2)).cache()
    assert split.count() == 2 * roster.count()
    per = split.groupBy("run", "individual").agg(
        F.countDistinct("encounter").alias("n"),
        F.countDistinct(F.when(F.col("role") == "db", F.col("encounter"))).alias("db"))
    wanted = F.when(F.col("n") == 1, 1).otherwise(F.least(F.col("n") - 1, F.lit(3)))
    assert per.filter(F.col("db") != wanted).count() == 0
    assert split.filter("run = 0 and role = 'db'").select("obs_id").subtract(
        split.filter("run = 1 and role = 'db'").select("obs_id")).count() > 0


def test_unknown_individuals_are_left_out(spark):
    roster = spark.createDataFrame([(1, "____", "a"), (2, "x", "a")], "obs_id long, individual string, encounter string")
    assert [r.obs_id for r in splits.split_db_query(roster).collect()] == [2]


def test_snapshots(spark):
    rows = [("a", "s1", dt.datetime(2024, 1, 1)), ("a", "s2", dt.datetime(2024, 1, 9)), ("b", "s3", dt.datetime(2024, 1, 5))]
    catalogue = spark.createDataFrame(rows, "tag string, snapshot_id string, created timestamp_ntz")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    got = {(r.tag, r.snapshot_id, r.action) for r in snapshots.latest_snapshot(catalogue, now).collect()}
    assert got == {("a", "s2", "reuse"), ("b", None, "create"), ("a", "s1", "expire")}


def test_load_or_create(spark):
    folder, calls = scratch_path(spark, "snap"), []

    def make():
        calls.append(1)
        return spark.range(5)

    empty = spark.createDataFrame([], "tag string, snapshot_id string, created timestamp_ntz")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    tag = snapshots.config_tag({"k": 2, "scales": [1, 2]})
    assert tag == snapshots.config_tag({"scales": [1, 2], "k": 2})
    assert snapshots.load_or_create(spark, empty, tag, now, folder, "20240110", make).count() == 5
    listed = spark.createDataFrame([(tag, f"{folder}/tag={tag}/created=20240110", dt.datetime(2024, 1, 10))],
                                   "tag string, snapshot_id string, created timestamp_ntz")
    assert snapshots.load_or_create(spark, listed, tag, now, folder, "20240111", make).count() == 5
    assert len(calls) == 1


def test_training_names_do_not_mix(tables):
    table = training.prepare_training_table(inputs.parts(tables), inputs.annots(tables)).cache()
    sides = table.select("name", "is_train").distinct().groupBy("name").count()
    assert sides.filter("count > 1").count() == 0
    names = table.select("name", "is_train").distinct()
    assert names.filter("is_train").count() == int(names.count() * 0.8)
    ordered = table.groupBy("contour_id").agg(F.min_by("x", "idx").alias("a"), F.max_by("x", "idx").alias("b"))
    assert ordered.filter("a > b").count() == 0


def test_stored_vectors_and_scale_folders(spark, tables):
    place = scratch_path(spark, "vec")
    vectors = inputs.vectors(tables)
    store.write_vectors(vectors, place)
    back = store.read_vectors(spark, place, ["1", "3"])
    assert back.count() == vectors.filter("scale in (1, 3)").count()
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "scale_key" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_folder_roster(spark, tmp_path):
    for name in ("A/e1done", "A/.e2done", "B/E3 Done", "B/raw"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "img.jpg").write_bytes(b"x")
    got = {(r.individual, r.encounter, r.side) for r in rosters.folder_roster(spark, str(tmp_path)).collect()}
    assert ("A", "e1done", "Left") in got and not any(e in (".e2done", "raw") for _, e, _ in got)


def test_readers_by_name(spark):
    readers = rosters.RosterReaders()
    readers.register("x", lambda: spark.range(3))
    assert readers.load("x").count() == 3
    with pytest.raises(KeyError):
        readers.load("y")


def test_stream_equals_batch(spark, tables):
    vectors = inputs.vectors(tables).cache()
    arriving, out, check = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    vectors.filter("owner < 20").coalesce(1).write.parquet(arriving)
    stream = spark.readStream.schema(vectors.schema).parquet(arriving)
    query = stream_scores(stream, lambda: vectors, out, check)
    query.awaitTermination(120)
    assert query.exception() is None
    keys = ["query_id", "target_id"]
    got = spark.read.parquet(out).select(*keys, F.round("score", 9)).collect()
    want = scoring.lnbnn_scores(vectors.filter("owner < 20"), vectors).select(*keys, F.round("score", 9)).collect()
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("level", ["name", "annotation"])
def test_split_queries_are_summed(spark, tables, level):
    """Queries whose vectors lie in two files: those with an end mark answer at once, the others after a while."""
    from resight.params import LnbnnParams
    from resight.streaming import split_queries

    params = LnbnnParams(level=level)
    spark.conf.set(*split_queries.STATE_STORE)
    vectors = inputs.vectors(tables).cache()
    asked = vectors.filter("owner < 12").withColumn("query_id", F.col("owner")).select("query_id", "scale", "vec_id", "vec")
    arriving, folder, out, one, two = (scratch_path(spark, n) for n in ("in", "evidence", "out", "chk", "chk"))
    halves = F.pmod(F.xxhash64("vec_id", "scale"), F.lit(2))
    marked = asked.withColumn("last", F.lit(False))
    for turn in range(2):
        part = marked.where(halves == turn)
        if turn:
            marks = part.where("query_id % 4 != 0").groupBy("query_id").agg(F.min("vec_id").alias("_v"))
            part = part.drop("last").join(marks, "query_id", "left").withColumn(
                "last", F.coalesce(F.col("vec_id") == F.col("_v"), F.lit(False))).drop("_v")
        part.coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    kind = marked.schema["query_id"].dataType

    def finish(query):
        query.awaitTermination(180)
        assert query.exception() is None and not query.isActive

    finish(split_queries.stream_evidence(stream, lambda: vectors, folder, one, params))
    assert len(spark.read.parquet(folder).select("batch").distinct().collect()) == 2
    keys = ["query_id", "target_id"]
    want = scoring.lnbnn_scores(asked.withColumn("owner", F.col("query_id")), vectors, params)
    want = {(r[0], str(r[1])): r[2] for r in want.select(*keys, F.round("score", 9)).collect()}

    def answers():
        rows = spark.read.schema("query_id long, target_id string, score double").parquet(out).collect()
        assert len({r[:2] for r in rows}) == len(rows)
        return {(r[0], r[1]): round(r[2], 9) for r in rows}

    query = split_queries.stream_totals(spark, folder, out, two, kind, 8000, params, {"processingTime": "1 second"})
    try:
        early = None
        for _ in range(120):
            time.sleep(1)
            assert query.exception() is None
            got = answers() if any(p.suffix == ".parquet" for p in Path(out).glob("*")) else {}
            early = early or got
            if len(got) == len(want):
                break
    finally:
        query.stop()
    assert got == pytest.approx(want) and any(k[0] % 4 for k in early)


def test_table_functions(spark):
    from resight.functions.tables import register_tables
    from resight.operators import warping
    from resight.params import WarpParams

    register_tables(spark)
    points = [(1, 0.5, i) for i in (7, 3, 3, 9)] + [(1, 0.7, 4), (2, 0.5, None), (2, 0.5, 8), (2, 0.5, 1)]
    frame = spark.createDataFrame(points, "contour_id long, scale double, idx int").repartition(3)
    got = spark.sql("SELECT * FROM keypoint_pairs(TABLE({p}) PARTITION BY (contour_id, scale))", p=frame).collect()
    assert sorted(map(tuple, got)) == [(1, 0.5, 3, 7), (1, 0.5, 3, 9), (1, 0.5, 7, 9), (2, 0.5, 1, 8)]
    draw = __import__("numpy").random.default_rng(1)
    rows = [(i, draw.uniform(size=32).tolist(), draw.uniform(size=32).tolist()) for i in range(20)]
    pairs = spark.createDataFrame([*rows, (20, None, rows[0][1])], "pair_id long, a array<double>, b array<double>")
    got = spark.sql("SELECT * FROM warped_distances(TABLE({p}), 'euclidean', 4, 2)", p=pairs).collect()
    want = warping.pair_distances(pairs.where("a IS NOT NULL"), WarpParams(window=4, length=16, cost="euclidean"), 2).collect()
    assert {r[0]: r[1] for r in got} == pytest.approx({**{r[0]: r[1] for r in want}, 20: None})


def _files(place):
    return {str(f): f.stat().st_mtime_ns for f in Path(place).rglob("*.parquet")}


def test_deletes_rewrite_only_the_parts_that_hold_the_ids(spark):
    place = scratch_path(spark, "derived")
    rows = [(i, (i * 7) % 50, f"t{i}") for i in range(50)] * 2 + [(None, 3, "n"), (4, None, "m"), (None, None, "o")]
    pairs = spark.createDataFrame(rows, "a long, aid long, text string")
    derived.create_derived(pairs, place, ["a", "aid"], parts=16)
    before = _files(f"{place}/rows")
    gone = spark.createDataFrame([(3,), (999,), (None,), (3,)], "aid long")
    touched = derived.delete_stored(spark, place, ["a", "aid"], gone)
    wanted = [r for r in rows if r[0] != 3 and r[1] != 3]
    got = [tuple(r) for r in derived.read_derived(spark, place).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    after = _files(f"{place}/rows")
    untouched = {f: m for f, m in before.items() if int(f.split("_part=")[1].split("/")[0]) not in touched}
    assert 0 < len(untouched) < len(before) and all(after.get(f) == m for f, m in untouched.items())
    assert derived.delete_stored(spark, place, ["a", "aid"], gone) == []
    # Parts that end empty lose their folder; what was deleted can come back.
    derived.delete_stored(spark, place, ["a", "aid"], spark.range(50).select(F.col("id").alias("aid")))
    assert [tuple(r) for r in derived.read_derived(spark, place).collect()] == [(None, None, "o")]
    derived.refresh_stored(spark, pairs.filter("text = 't9'"), place, ["text"], ["a", "aid"], lambda new: new.distinct())
    derived.refresh_stored(spark, pairs.filter("text = 't9'"), place, ["text"], ["a", "aid"], lambda new: new.distinct())
    assert sorted(map(str, (r.text for r in derived.read_derived(spark, place).collect()))) == ["o", "t9"]


SMALL_BLOCKS = NeighbourParams(block_rows=8, db_block_rows=16, blocks_per_salt=1)


def _vectors(spark):
    import numpy as np

    base = np.random.default_rng(1).normal(size=(400, 6))
    base[:130] = base[0]
    rows = [("a" if i % 3 else "b", i, [float(x) for x in r], i % 7) for i, r in enumerate(base)]
    return spark.createDataFrame(rows + [("a", 1000, None, 1), (None, 1001, [1.0] * 6, 1)], "scale string, vec_id long, vec array<double>, target int")


def test_stored_index_equals_a_plain_search(spark):
    d = _vectors(spark)
    q = d.withColumn("query_id", F.col("vec_id") % 11).drop("target")
    index = stored_index.write_index(d, scratch_path(spark, "index"), SMALL_BLOCKS)
    whole = "vec is not null and scale is not null"
    got = stored_index.stored_neighbours(q, index, 4, SMALL_BLOCKS)
    want = neighbours.neighbours(q.filter(whole), d.filter(whole), 4, "blocked")
    shown = [x.select("query_id", "scale", "q_vec", "d_vec", "target", F.round("dist", 9).alias("dist")) for x in (got, want)]
    assert sorted(map(str, shown[0].collect())) == sorted(map(str, shown[1].collect()))
    # A third of the rows are one vector: its cell fills several buckets.
    assert index.cells.select(F.inline("_centres")).agg(F.max("salts")).first()[0] > 4
    assert index.blocks.agg(F.max(F.size("_items"))).first()[0] < 64
    empty = stored_index.write_index(d.limit(0), scratch_path(spark, "index"), SMALL_BLOCKS)
    assert stored_index.stored_neighbours(q, empty, 4, SMALL_BLOCKS).count() == 0
    assert stored_index.stored_neighbours(q.limit(0), index, 4, SMALL_BLOCKS).count() == 0


def test_a_second_search_reuses_the_index_and_does_not_shuffle_it(spark):
    d = _vectors(spark).filter("vec is not null and scale is not null").select(
        "scale", "vec_id", "vec", F.col("target").alias("label"), F.col("vec_id").alias("owner"))
    built, params = [], LnbnnParams(neighbours=SMALL_BLOCKS)

    def build(place):
        built.append(place)
        return scoring.index_vectors(d, place, params)

    folder, now = scratch_path(spark, "indexes"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "tag string, snapshot_id string, created timestamp_ntz")
    first, place = snapshots.load_or_build_index(spark, empty, "t", now, folder, "20240110", build)
    listed = spark.createDataFrame([("t", place, dt.datetime(2024, 1, 10))], empty.schema)
    # As in another session: the catalogue does not know the table.
    spark.sql("DROP TABLE " + stored_index._table_name(place))
    second, again = snapshots.load_or_build_index(spark, listed, "t", now, folder, "20240111", build)
    assert built == [place] and again == place
    scores = scoring.lnbnn_scores(d, second, params)
    key = lambda rows: sorted((r.query_id, r.target_id, round(r.score, 9)) for r in rows)
    assert key(scores.collect()) == key(scoring.lnbnn_scores(d, d, params).collect())
    found = stored_index.stored_neighbours(d.withColumnRenamed("owner", "query_id"), second, 3, SMALL_BLOCKS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex("SortMergeJoin [cell"):]
    scan = side[:side.index("resight_index")]
    assert "Exchange" not in scan[scan.rindex("+- Sort [cell"):] and "Bucketed: true" in side


def test_search_beyond_the_bound_of_pivots(spark):
    d = _vectors(spark).filter("vec is not null and scale is not null")
    q = d.withColumn("query_id", F.col("vec_id") % 11).drop("target")
    few = SMALL_BLOCKS.__class__(block_rows=8, db_block_rows=16, blocks_per_salt=1, max_pivot_cells=1)
    got, want = (neighbours.neighbours(q, d, 3, "exact", p) for p in (few, SMALL_BLOCKS))
    shown = [x.select("query_id", "scale", "q_vec", "d_vec", "target", F.round("dist", 9).alias("dist")) for x in (got, want)]
    assert sorted(map(str, shown[0].collect())) == sorted(map(str, shown[1].collect()))


def test_cells_out_of_reach_are_not_measured(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.normal(size=(40, 4))[rng.integers(0, 40, 1600)] * 10 + rng.normal(size=(1600, 4)) * 0.1
    d = spark.createDataFrame([(1, i, [float(x) for x in p], i % 5) for i, p in enumerate(points)],
                              "scale int, vec_id long, vec array<double>, target int")
    index = stored_index.write_index(d, scratch_path(spark, "index"), SMALL_BLOCKS)
    row = stored_index.measured_share(d.withColumn("query_id", F.col("vec_id")), index, 3, SMALL_BLOCKS).first()
    assert row["pairs"] == 1600 * 1600 and 0 < row["measured"] < 0.25 * row["pairs"]


def test_a_stored_search_copies_a_query_to_few_parts(spark):
    """Every cell is in reach of vectors spread evenly, and equal vectors fill several parts."""
    import dataclasses

    import numpy as np

    params = dataclasses.replace(SMALL_BLOCKS, part_rows=16)
    rng = np.random.default_rng(5)
    even = spark.createDataFrame([("even", i, [float(x) for x in r], i % 5) for i, r in enumerate(rng.normal(size=(700, 8)))],
                                 "scale string, vec_id long, vec array<double>, target int")
    d = _vectors(spark).filter("vec is not null and scale is not null").unionAll(even)
    q = d.withColumn("query_id", F.col("vec_id") % 11).drop("target")
    index = stored_index.write_index(d, scratch_path(spark, "index"), params)
    number = index.blocks.groupBy("scale").agg(F.countDistinct("cell_part").alias("parts"), F.countDistinct("cell").alias("cells")).collect()
    assert all(r["parts"] == params.max_parts for r in number) and max(r["cells"] for r in number) > 30
    asked = stored_index._copies(q, index, 3, params).groupBy("scale").count().join(q.groupBy("scale").agg(F.count("*").alias("n")), "scale")
    assert all(r["n"] <= r["count"] <= params.max_parts * r["n"] for r in asked.collect())
    got = stored_index.stored_neighbours(q, index, 3, params)
    want = neighbours.neighbours(q, d, 3, "blocked")
    shown = [x.select("query_id", "scale", "q_vec", "d_vec", "target", F.round("dist", 9).alias("dist")) for x in (got, want)]
    assert sorted(map(str, shown[0].collect())) == sorted(map(str, shown[1].collect()))

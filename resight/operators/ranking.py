"""Ranks of the true individual, accuracy curves and reports over score tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resight.operators.tiles import dense_index, running_total
from resight.session import cut


def ranked(scores: DataFrame, keys: list[str] | None = None, target: str = "target_id") -> DataFrame:
    """Ascending rank from 1; ties go to the smaller id."""
    w = W.partitionBy(*(keys or ["query_id"])).orderBy("score", target)
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_names(scores: DataFrame, n: int, keys: list[str] | None = None, target: str = "target_id") -> DataFrame:
    """The n best targets per query (all for n < 0); Spark limits each query before the shuffle."""
    every = ranked(scores, keys, target)
    return every if n < 0 else every.filter(F.col("rank") <= n)


def result_table(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Scores with names, best first; a target without a name has null."""
    return scores.join(names, "target_id", "left").orderBy("query_id", "score", "target_id")


#: Scores of one query that meet its true individual in one task.
BLOCK = 1 << 20


def scores_beside(asked: DataFrame, scores: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Rows of `asked`, each beside every score of its query; one without scores stays, beside nulls.

    The rows of a query with more than `block` scores are copied to as many parts as it has blocks, and its scores are
    dealt to these by target, so no query is one task's work. Such queries are at most a `block`-th of all scores.
    """
    # Counted from the columns that are dealt: a plain count would drop `score` from the plan and a costly table of scores
    # would be made a second time, where Spark now uses its shuffle again.
    number = F.count("score") + F.count(F.when(F.col("score").isNull(), F.lit(1)))
    crowded = scores.groupBy(*keys).agg(number.alias("_n")).filter(F.col("_n") > block).select(
        *keys, F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    copies = asked.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = scores.select(*keys, "target_id", "score").join(crowded, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64("target_id"), parts).cast("int")).drop("_parts")
    return copies.join(dealt, [*keys, "_part"], "left")


def by_query(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores dealt by query. Whoever reads the same columns of this reads the same shuffle: the scores are made once."""
    return scores.select(*keys, "target_id", "score").repartition(*keys)


def shuffled_once_beside(asked: DataFrame, scores: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """As `scores_beside`, for scores that are dear to make: they are made and shuffled once, by query, as `by_query` has them.

    Only those of queries with more than `block` scores are dealt to parts after that.
    """
    dealt = by_query(scores, keys)
    # Counted from all the columns that are dealt: a plain count would drop some of them, and so have a shuffle of its own.
    empty = F.col("target_id").isNull() & F.col("score").isNull()
    number = F.count(F.when(empty, F.lit(1))) + F.count(F.when(~empty, F.lit(1)))
    crowded = dealt.groupBy(*keys).agg(number.alias("_n")).filter(F.col("_n") > block).select(
        *keys, F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    # Scores stream past the rows asked for, and are not sorted.
    few = asked.join(crowded, keys, "left_anti").hint("shuffle_hash").join(dealt, keys, "left")
    copies = asked.join(crowded, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    spread = dealt.join(crowded.hint("shuffle_hash"), keys).withColumn(
        "_part", F.pmod(F.xxhash64("target_id"), F.col("_parts")).cast("int")).drop("_parts")
    many = copies.join(spread, [*keys, "_part"], "left").drop("_part")
    return few.unionByName(many)


def true_ranks(
    scores: DataFrame, truth: DataFrame, keys: list[str], database: DataFrame | None = None, block: int = BLOCK
) -> DataFrame:
    """Rank of the true individual of each query, or -1 if the database does not hold it.

    The rank is counted, not sorted: one plus the targets that come before the true one. The
    counts are combined before the shuffle, and a query with more than `block` targets is counted
    in parts. With `database` (per-run target ids) the scores may be sparse: a missing score is 0.
    Truth has the keys and `ind`; scores have the keys, target_id and score.
    """
    if database is None:
        # Their query meets all scores where these are dealt to be counted: an equality of `ind` would shuffle them again, and
        # a filter of null targets, which the optimizer puts before a shuffle where it can, would make another shuffle of it.
        wanted = truth.select(*keys, F.col("ind").alias("_ind")).distinct().hint("shuffle_hash")
        dealt = by_query(scores, keys)
        other = (dealt["target_id"] < wanted["_ind"]) | (dealt["target_id"] > wanted["_ind"])
        found = reduce(and_, [dealt[k] == wanted[k] for k in keys], F.coalesce(~other, F.lit(False)))
        # Not a semi-join: that would pass below the shuffle.
        own = dealt.join(wanted, found).select(*(dealt[k].alias(f"_of_{k}") for k in keys), "_ind", F.col("score").alias("_own"))
        same = reduce(and_, [truth[k] == own[f"_of_{k}"] for k in keys], truth["ind"].eqNullSafe(own["_ind"]))
        marked = truth.join(own, same, "left").select(*truth.columns, "_own").withColumn("_known", F.col("_own").isNotNull())
    else:
        shared = [k for k in keys if k in database.columns]
        # Both are read several times below, and each may stand for a pass over a large table: they are written once.
        database = cut(database.select(*shared, "target_id").distinct(), "database")
        # Dense place of each individual in the database by id, for ties at score 0.
        held = dense_places(database, shared)
        scores = cut(scores.select(*keys, "target_id", "score").join(database, [*shared, "target_id"], "left_semi"), "held")
        own = scores.select(*keys, F.col("target_id").alias("ind"), F.col("score").alias("_own"))
        size = F.count(F.lit(1)).alias("_size")
        if shared:
            held = held.join(held.groupBy(*shared).agg(size), shared)
        else:
            held = held.withColumn("_size", F.lit(held.agg(size).first()[0]))
        marked = (
            truth.join(held, [*shared, "ind"], "left").join(own, [*keys, "ind"], "left")
            .withColumn("_known", F.col("_place").isNotNull())
            .withColumn("_own", F.when(F.col("_known"), F.coalesce("_own", F.lit(0.0))))
        )
    before = (F.col("score") < F.col("_own")) | (
        (F.col("score") == F.col("_own")) & (F.col("target_id") < F.col("ind"))
    )
    met = (shuffled_once_beside if database is None else scores_beside)(marked, scores, keys, block)
    counted = [F.count(F.when(before, F.lit(1))).alias("_before")]
    group = [*keys, "ind", "_known", "_own"]
    if database is not None:
        group += ["_place", "_size"]
        counted.append(F.count("target_id").alias("_listed"))
        counted.append(F.count(F.when(F.col("target_id") < F.col("ind"), F.lit(1))).alias("_listed_smaller"))
    ranks = met.groupBy(*group).agg(*counted)
    rank = F.col("_before") + 1
    if database is not None:
        # Unlisted individuals tie at 0 and come before by id, or all of them if the own score is positive.
        unlisted = F.col("_place") - F.col("_listed_smaller")
        every = F.col("_size") - F.col("_listed")
        rank = rank + F.when(F.col("_own") == 0.0, unlisted).when(F.col("_own") > 0.0, every).otherwise(F.lit(0))
    return ranks.select(*keys, "ind", F.when(F.col("_known"), rank).otherwise(F.lit(-1)).cast("bigint").alias("rank"))


def dense_places(database: DataFrame, shared: list[str], cuts: int = 255) -> DataFrame:
    """Number of database individuals with a smaller id, per run.

    A fixed number of ids drawn by hash cuts the id range into buckets, so no run is numbered
    in a single task.
    """
    ids = database.select(*shared, F.col("target_id").alias("ind")).distinct()
    drawn = ids.select("ind").distinct().orderBy(F.xxhash64("ind"), "ind").limit(cuts).collect()
    kind = ids.schema["ind"].dataType.simpleString()
    bounds = F.lit([row["ind"] for row in drawn]).cast(f"array<{kind}>") if drawn else F.array().cast(f"array<{kind}>")
    bucket = F.size(F.filter(bounds, lambda b: b <= F.col("ind")))
    return dense_index(ids, shared, ["ind"], bucket, out="_place")


def reciprocal_ranks(ranks: DataFrame) -> DataFrame:
    """(run, ind, num, mrr) over known individuals."""
    return ranks.filter(F.col("rank") > 0).groupBy("run", "ind").agg(
        F.count(F.lit(1)).alias("num"), F.avg(1.0 / F.col("rank")).alias("mrr")
    )


def accuracy_curve(ranks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(run, k, accuracy) for k = 1 … number of database individuals.

    A histogram of ranks is summed along k, so queries are never paired with every k.
    `sizes` has run and n_individuals.
    """
    known = ranks.filter(F.col("rank") > 0)
    hits = known.groupBy("run", F.col("rank").alias("k")).agg(F.count(F.lit(1)).alias("_hits"))
    totals = known.groupBy("run").agg(F.count(F.lit(1)).alias("_total"))
    # Levels come in pieces, so no row holds an array as long as the database.
    starts = sizes.select("run", "n_individuals", F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.col("n_individuals"), F.lit(65536).cast("bigint"))).alias("_from"))
    levels = starts.select("run", F.explode(
        F.sequence("_from", F.least(F.col("_from") + 65535, F.col("n_individuals")))).alias("k"))
    filled = levels.join(hits, ["run", "k"], "left").select(
        "run", "k", F.coalesce("_hits", F.lit(0)).cast("bigint").alias("_hits")
    )
    summed = running_total(filled, ["run"], "_hits", "_within", idx="k")
    return summed.join(totals, "run").select(
        "run", "k", (F.col("_within") * 100.0 / F.col("_total")).alias("accuracy")
    )


def across_runs(curve: DataFrame) -> DataFrame:
    return curve.groupBy("k").agg(
        F.avg("accuracy").alias("mean"), F.min("accuracy").alias("min"), F.max("accuracy").alias("max"),
        F.stddev_pop("accuracy").alias("std"),
    )


def misidentifications(scores: DataFrame, num_qr: int, num_db: int) -> DataFrame:
    """Report rows for the best query images of each encounter.

    `scores` has encounter, qind, q_image, d_image, dind, score. For the `num_qr` images with the
    smallest score, their `num_db` best database images, and place and score of the best image
    of the true individual (null if the database holds none).
    """
    key = ["encounter", "qind", "q_image"]
    best = scores.groupBy(*key).agg(
        F.min("score").alias("_best"),
        F.min(F.when(F.col("dind") == F.col("qind"), F.struct(F.col("score").alias("s"), F.col("d_image").alias("d"))))
        .alias("_true"),
    )
    by_image = W.partitionBy("encounter", "qind").orderBy("_best", "q_image")
    chosen = best.withColumn("q_rank", F.row_number().over(by_image)).filter(F.col("q_rank") <= num_qr)
    kept = scores.join(chosen, key)
    true_place = kept.groupBy(*key).agg(
        F.count(F.when(
            (F.col("score") < F.col("_true.s")) | ((F.col("score") == F.col("_true.s")) & (F.col("d_image") < F.col("_true.d"))),
            F.lit(1),
        )).alias("_ahead")
    )
    by_db = W.partitionBy(*key).orderBy("score", "d_image")
    top = kept.withColumn("d_rank", F.row_number().over(by_db)).filter(F.col("d_rank") <= num_db)
    return top.join(true_place, key).select(
        *key, F.col("q_rank").cast("bigint").alias("q_rank"), F.col("d_rank").cast("bigint").alias("d_rank"),
        "d_image", "dind", "score",
        F.when(F.col("_true").isNotNull(), F.col("_ahead") + 1).cast("bigint").alias("true_rank"),
        F.col("_true.s").alias("true_score"),
    )

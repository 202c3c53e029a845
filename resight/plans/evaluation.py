"""Evaluation of a score table against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.operators import ranking as R
from resight.session import cut


def with_unlisted(scores: DataFrame, truth: DataFrame, database: DataFrame, max_names: int) -> DataFrame:
    """Scores of database individuals, and at 0 those that a query of `truth` has no score for.

    With `max_names` these are not all: among the first `max_names` + n individuals by id, n being the number of
    scores of the query, `max_names` have no score, and no later one can be among the `max_names` best.
    """
    keys = ["run", "enc"]
    held = database.select("run", "target_id").distinct()
    listed = scores.select(*keys, "target_id", "score").join(held, ["run", "target_id"], "left_semi")
    number = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = held.groupBy("run").agg(F.count(F.lit(1)).alias("_size"))
    asked = truth.select(*keys).distinct().join(size, "run").join(number, keys, "left")
    most = F.col("_size") if max_names < 0 else F.least("_size", F.lit(max_names) + F.coalesce("_n", F.lit(0)))
    pieces = asked.select(*keys, most.alias("_most")).filter("_most > 0").withColumn(
        "_from", F.explode(F.expr("sequence(0L, _most - 1, 65536L)")))
    wanted = pieces.select(*keys, F.explode(F.expr("sequence(_from, least(_from + 65535, _most - 1))")).alias("_place"))
    by_place = R.dense_places(held, ["run"]).select(
        "run", F.col("_place").cast("bigint").alias("_place"), F.col("ind").alias("target_id"))
    first = wanted.join(by_place, ["run", "_place"]).select(*keys, "target_id")
    missing = first.join(listed, [*keys, "target_id"], "left_anti")
    return listed.unionByName(missing.withColumn("score", F.lit(0.0)))


def evaluate(
    scores: DataFrame, truth: DataFrame, max_names: int = -1, database: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Four tables: all, mrr, topk, agg.

    scores(run, enc, target_id, score) is dense unless `database(run, target_id)` is given, in
    which case a missing score counts as 0. truth(run, enc, ind). The ranking of a query is an
    array only when `max_names` bounds it; otherwise it comes as rows (position, name).
    """
    keys = ["run", "enc"]
    # All four tables start from the ranks, so these are written once.
    ranks = cut(R.true_ranks(scores, truth, keys, database), "ranks")
    held = scores if database is None else database
    sizes = held.select("run", "target_id").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("n_individuals"))
    order = R.top_names(scores if database is None else with_unlisted(scores, truth, database, max_names), max_names, keys)
    if max_names > 0:
        lists = order.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id"))), lambda e: e["target_id"])
            .alias("ranking")
        )
        listed = ranks.join(lists, keys, "left")
    else:
        places = order.select(*keys, F.col("rank").alias("position"), F.col("target_id").alias("ranking"))
        listed = ranks.join(places, keys, "left")
    curve = R.accuracy_curve(ranks, sizes)
    return {"all": listed, "mrr": R.reciprocal_ranks(ranks), "topk": curve, "agg": R.across_runs(curve)}

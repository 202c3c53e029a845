"""Local naive-Bayes nearest-neighbour evidence and what is built on its score table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEIGHBOUR_KEYS = ["query_id", "scale", "q_vec"]


def evidence(neighbours: DataFrame) -> DataFrame:
    """Per query vector and class: distance of its nearest member minus the normalising distance.

    The normaliser is the last neighbour returned, also when fewer than asked for exist. A
    class counts once per query vector. The group holds k+1 rows at most.
    """
    near = neighbours.groupBy(*NEIGHBOUR_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("dist", "d_vec", "target"))).alias("_near")
    )
    ranked = near.withColumn("_last", F.element_at("_near", -1)["dist"]).withColumn(
        "_kept", F.slice("_near", F.lit(1), F.size("_near") - 1)
    )
    first_of_class = F.expr(
        "filter(_kept, (x, i) -> array_position(transform(_kept, y -> y.target), x.target) = i + 1)"
    )
    hits = ranked.select(*NEIGHBOUR_KEYS, "_last", F.explode(first_of_class).alias("_hit"))
    return hits.select(
        *NEIGHBOUR_KEYS, F.col("_hit.target").alias("target_id"), (F.col("_hit.dist") - F.col("_last")).alias("score")
    )


def scale_scores(found: DataFrame) -> DataFrame:
    """Evidence summed over the vectors of a query, per scale."""
    return found.groupBy("query_id", "scale", "target_id").agg(F.sum("score").alias("score"))


def total_scores(found: DataFrame) -> DataFrame:
    """Evidence summed over vectors and scales (one shuffle; partial sums come first)."""
    return found.groupBy("query_id", "target_id").agg(F.sum("score").alias("score"))


def fill_classes(scores: DataFrame, queries: DataFrame, classes: DataFrame, spread: int = 64) -> DataFrame:
    """Every (query, class) with 0.0 where no evidence exists.

    The dense table is the result itself. Classes are packed into parts and queries into hands;
    a part meets a hand under its own join key, so the spread x spread keys share the work and
    each output row is produced once.
    """
    hand = F.pmod(F.xxhash64("query_id"), F.lit(spread)).cast("int")
    part = F.pmod(F.xxhash64("target_id"), F.lit(spread)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    packed = (
        classes.select("target_id").distinct()
        .withColumns({"_part": part, "_block": F.pmod(F.xxhash64("target_id", F.lit(1)), F.lit(1024))})
        .groupBy("_part", "_block").agg(F.collect_list("target_id").alias("_ids"))
        .withColumn("_hand", every)
    )
    asked = queries.select("query_id").distinct().withColumn("_hand", hand).withColumn("_part", every)
    grid = asked.hint("merge").join(packed, ["_hand", "_part"]).select("query_id", F.explode("_ids").alias("target_id"))
    return (
        grid.join(scores, ["query_id", "target_id"], "left")
        .select("query_id", "target_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    )


def sparsify(scores: DataFrame, minimum_score: float = -1e-5, own: DataFrame | None = None) -> DataFrame:
    """Keep rows below `minimum_score`; drop targets that are annotations of the query itself.

    `own` has (query_id, target_id) and is given at annotation level only: a name id that
    happens to equal an annotation id must not vanish.
    """
    strong = scores.filter(F.col("score") < F.lit(minimum_score))
    if own is None:
        return strong
    return strong.join(own.select("query_id", "target_id").distinct(), ["query_id", "target_id"], "left_anti")


def without_self(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("daid") != F.col("qaid"))


def answer_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """One larger-is-better score per requested pair; 0.0 where there is no evidence."""
    known = scores.select(F.col("query_id").alias("qaid"), F.col("target_id").alias("daid"), "score")
    value = F.coalesce(-F.col("score"), F.lit(0.0)) + F.lit(0.0)
    return pairs.select("qaid", "daid").join(known, ["qaid", "daid"], "left").select("qaid", "daid", value.alias("score"))


def answer_groups(queries: DataFrame, members: DataFrame, scores: DataFrame, page: int = 4096, spread: int = 64) -> DataFrame:
    """As `answer_pairs` for every query of a group beside every member of it: qaid, daid, score and the members' other columns.

    queries(qaid, group), members(group, daid, …); scores hold a pair once, and of a query no more than its neighbours. A query
    takes its scores along and meets pages of at most about `page` members, so no pair is shuffled. A group is dealt to
    `spread` join keys by query, and its pages are copied to these.
    """
    found = scores.filter(F.col("target_id").isNotNull()).groupBy(F.col("query_id").alias("qaid")).agg(
        F.collect_list(F.struct("target_id", "score")).alias("_k"))
    asked = queries.select("qaid", "group").join(found, "qaid", "left").select(
        "qaid", "group", F.pmod(F.xxhash64("qaid"), F.lit(spread)).cast("int").alias("_salt"),
        F.col("_k.target_id").alias("_ids"), F.col("_k.score").alias("_scores"))
    columns = [c for c in members.columns if c != "group"]
    pages = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(page)).cast("bigint").alias("_pages"))
    lists = (
        members.join(pages, "group")
        .groupBy("group", F.pmod(F.xxhash64("daid"), F.col("_pages")).alias("_page"))
        .agg(F.collect_list(F.struct(*columns)).alias("_members"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    )
    # An explicit number: the rows are few but make many, so they must not be merged into few tasks by their byte size.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [side.repartition(tasks, "group", "_salt") for side in (asked, lists)]
    each = dealt[0].hint("merge").join(dealt[1], ["group", "_salt"]).select("qaid", "_ids", "_scores", F.explode("_members").alias("_m"))
    place = F.array_position("_ids", F.col("_m.daid")).cast("int") - 1
    value = F.coalesce(-F.get("_scores", place), F.lit(0.0)) + F.lit(0.0)
    rest = [F.col(f"_m.{c}").alias(c) for c in columns if c != "daid"]
    return each.select("qaid", F.col("_m.daid").alias("daid"), value.alias("score"), *rest)


def name_scores(pairs: DataFrame) -> DataFrame:
    """Sum of annotation scores per (query, name); pairs(qaid, daid, dnid, score)."""
    return pairs.groupBy("qaid", "dnid").agg(F.sum("score").alias("name_score"))


def candidate_lists(pairs: DataFrame, page: int = 4096) -> DataFrame:
    """Candidates of each query as ordered lists of at most about `page` entries."""
    counted = pairs.groupBy("qaid").agg(F.ceil(F.count(F.lit(1)) / F.lit(page)).cast("bigint").alias("_pages"))
    paged = pairs.join(counted.filter("_pages > 1"), "qaid", "left").withColumn(
        "page", F.pmod(F.xxhash64("daid"), F.coalesce("_pages", F.lit(1)))
    )
    lists = paged.groupBy("qaid", "page").agg(F.array_sort(F.collect_list(F.struct("daid", "score"))).alias("_c"))
    return lists.select("qaid", "page", F.col("_c.daid").alias("daids"), F.col("_c.score").alias("scores"))


def best_pairs(distances: DataFrame) -> DataFrame:
    """Smallest distance over all pairs of a query and an individual."""
    return distances.groupBy("query_id", "target_id").agg(F.min("score").alias("score"))


def only_queries(results: DataFrame, wanted: DataFrame, key: str = "query_id") -> DataFrame:
    return results.join(wanted.select(key).distinct(), key, "left_semi")

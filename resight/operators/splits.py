"""Database/query splits and the statistics about rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resight.functions import text
from resight.operators import filters
from resight.params import SplitParams


def _encounters(roster: DataFrame) -> DataFrame:
    """Images per (individual, encounter)."""
    return roster.groupBy("individual", "encounter").agg(F.count(F.lit(1)).alias("n_images"))


def random_roles(roster: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """(run, individual, encounter, role): up to `num_db` encounters per individual go to the database.

    The order is a hash of seed, run, individual and encounter, so every run can be repeated.
    Only the first `num_db` places of an individual are ranked, which Spark limits before the
    shuffle; a much-seen individual is never sorted as a whole.
    """
    known = filters.known_names(roster, params.unknown)
    encounters = known.select("individual", "encounter").distinct()
    counts = encounters.groupBy("individual").agg(F.count(F.lit(1)).alias("_n"))
    runs = F.explode(F.sequence(F.lit(0), F.lit(params.runs - 1))).alias("run")
    drawn = encounters.select("*", runs)
    key = text.shuffle_key(params.seed, F.col("run"), F.col("individual"), F.col("encounter"))
    order = W.partitionBy("run", "individual").orderBy("_key", "encounter")
    first = (
        drawn.withColumn("_key", key).withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= params.num_db)
        .join(counts, "individual")
        .filter(
            (F.col("_n") == 1) | (F.col("_place") <= F.least(F.col("_n") - 1, F.lit(params.num_db)))
        )
        .select("run", "individual", "encounter", F.lit(True).alias("_db"))
    )
    role = F.when(F.col("_db"), F.lit("db")).otherwise(F.lit("query"))
    return drawn.join(first, ["run", "individual", "encounter"], "left").select(
        "run", "individual", "encounter", role.alias("role")
    )


def largest_roles(roster: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """The encounter with most images is the database (smallest id on ties); the others are queries."""
    sizes = _encounters(roster)
    best = sizes.groupBy("individual").agg(
        F.min(F.struct((-F.col("n_images")).alias("neg"), F.col("encounter").alias("encounter"))).alias("_best")
    )
    chosen = best.select("individual", F.col("_best.encounter").alias("encounter"), F.lit(True).alias("_db"))
    role = F.when(F.col("_db"), F.lit("db")).otherwise(F.lit("query"))
    runs = F.explode(F.sequence(F.lit(0), F.lit(params.runs - 1))).alias("run")
    return sizes.join(chosen, ["individual", "encounter"], "left").select(
        runs, "individual", "encounter", role.alias("role")
    )


def split_db_query(roster: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """(run, obs_id, individual, encounter, role)."""
    if params.strategy == "random":
        roles, rows = random_roles(roster, params), filters.known_names(roster, params.unknown)
    elif params.strategy == "largest":
        roles, rows = largest_roles(roster, params), roster
    else:
        raise ValueError(f"unknown strategy {params.strategy}")
    return rows.join(roles, ["individual", "encounter"]).select("run", "obs_id", "individual", "encounter", "role")


def split_statistics(split: DataFrame) -> DataFrame:
    """Most, mean and fewest images per database individual and per query encounter, per run."""
    database = (
        split.filter(F.col("role") == "db").groupBy("run", "individual").agg(F.count(F.lit(1)).alias("_n"))
        .select("run", F.lit("db").alias("role"), "_n")
    )
    queries = (
        split.filter(F.col("role") == "query").groupBy("run", "individual", "encounter")
        .agg(F.count(F.lit(1)).alias("_n")).select("run", F.lit("query").alias("role"), "_n")
    )
    return database.unionByName(queries).groupBy("run", "role").agg(
        F.max("_n").alias("most"), F.avg("_n").alias("mean"), F.min("_n").alias("fewest")
    )


def histogram(values: DataFrame, value: str, first: int = 1, last: int = 19) -> DataFrame:
    """Density over whole-number bins [b, b+1); the last bin also holds `last` itself."""
    within = values.filter((F.col(value) >= first) & (F.col(value) <= last))
    place = F.least(F.floor(value).cast("bigint"), F.lit(last - 1).cast("bigint"))
    counts = within.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    # At most last - first rows from here on.
    total = F.sum("_n").over(W.partitionBy())
    shares = counts.select("bin", (F.col("_n") / total).alias("density"))
    bins = values.sparkSession.range(first, last).select(F.col("id").alias("bin"))
    return bins.join(shares, "bin", "left").select("bin", F.coalesce("density", F.lit(0.0)).alias("density"))


def encounter_statistics(roster: DataFrame) -> DataFrame:
    """(bin, images_density, encounters_density) over individuals with more than one encounter.

    The number of encounters of an individual is counted once per encounter.
    """
    sizes = _encounters(roster)
    counts = sizes.groupBy("individual").agg(F.count(F.lit(1)).alias("n_encounters")).filter("n_encounters > 1")
    kept = sizes.join(counts, "individual")
    images = histogram(kept, "n_images").withColumnRenamed("density", "images_density")
    encounters = histogram(kept, "n_encounters").withColumnRenamed("density", "encounters_density")
    return images.join(encounters, "bin")


def success_report(status: DataFrame, flag: Column | None = None) -> DataFrame:
    ok = F.col("success") if flag is None else flag
    return status.agg(
        F.count(F.when(ok, F.lit(1))).alias("n_success"), F.count(F.lit(1)).alias("n_total")
    ).withColumn("ratio", F.when(F.col("n_total") > 0, F.col("n_success") / F.col("n_total")))


def distinct_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct()


def set_label(rows: DataFrame, keys: list[str], value: str, out: str = "label") -> DataFrame:
    """Distinct values of each group joined by '-' in sorted order; duplicates go before the shuffle."""
    once = rows.select(*keys, value).distinct()
    return once.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), "-").alias(out))


def shares_nothing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows common to both sides; empty when the split is clean."""
    return left.select(key).intersect(right.select(key))

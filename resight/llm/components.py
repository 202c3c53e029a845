"""Connected components of an edge table, by alternating large and small stars. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.session import cut_and_observe, discard


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node of its component) of every node that an edge names.

    Every round points the larger neighbours of a node at its smallest one and then, from the other side, the smaller
    ones; rounds go on until the number of edges and the sum of their hashes stand still, about log2 of the longest path.
    A node of very many edges is reduced by partial sums, never gathered. Null ends and loops are dropped, repeated
    edges count once, no edges give no rows.
    """
    spark = edges.sparkSession
    state = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    mark = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        table, seen = cut_and_observe(df, "edges", F.count(F.lit(1)).alias("n"), mark.alias("mark"))
        return table, (seen["n"], seen["mark"])

    state, seen = stored(state)
    while seen[0]:
        both = state.select("u", "v").unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: a larger neighbour hangs on the smallest node of the neighbourhood.
        big = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big, _ = stored(big.where(F.col("u") != F.col("v")).distinct())
        # Small star: the smaller neighbours, and the node itself, hang on the smallest one.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
        after, now = stored(small.where(F.col("u") != F.col("v")).distinct())
        discard(spark, state, big)
        state, before, seen = after, seen, now
        if before == seen:
            break
    # A star whose centre is its component's smallest node.
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

"""Sharding by a Feistel permutation of global row numbers, with cycle walking. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resight.session import cut

ROUNDS = 6


def _round(left: Column, right: Column, index: int, wide: int, tall: int, seed: int) -> tuple[Column, Column]:
    """One Feistel round on (left < wide, right < tall); rounds change either half in turn."""
    if index % 2 == 0:
        return F.pmod(left + F.pmod(F.xxhash64(right, F.lit(index), F.lit(seed)), F.lit(wide)), F.lit(wide)), right
    return left, F.pmod(right + F.pmod(F.xxhash64(left, F.lit(index), F.lit(seed)), F.lit(tall)), F.lit(tall))


def domain(rows: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds `rows` places; it has fewer than one side too many."""
    wide = max(1, math.isqrt(max(0, rows - 1)) + 1) if rows > 0 else 1
    return wide, max(1, -(-rows // wide))


def permute_once(df: DataFrame, place: str, rows: int, seed: int, only_outside: bool = False) -> DataFrame:
    """Replace `place`, a number below wide * tall, by its image; with `only_outside` only where it is `rows` or more."""
    wide, tall = domain(rows)
    df = df.withColumns({"_l": F.floor(F.col(place) / F.lit(tall)) if rows < 2**52 else F.expr(f"`{place}` div {tall}"),
                         "_r": F.pmod(F.col(place), F.lit(tall))})
    for index in range(ROUNDS):
        left, right = _round(F.col("_l"), F.col("_r"), index, wide, tall, seed)
        df = df.withColumns({"_l": left} if index % 2 == 0 else {"_r": right})
    image = F.col("_l") * F.lit(tall) + F.col("_r")
    return df.withColumn(place, F.when(F.col(place) >= rows, image).otherwise(F.col(place)) if only_outside else image
                         ).drop("_l", "_r")


def walk_length(spark: SparkSession, rows: int, seed: int) -> int:
    """Steps after the first that lead every walk back below `rows`: walks over the fewer than sqrt(rows) outer places."""
    wide, tall = domain(rows)
    if wide * tall == rows:
        return 0
    steps, outer = 1, permute_once(spark.range(rows, wide * tall).withColumnRenamed("id", "p"), "p", rows, seed)
    while (outer := cut(outer.where(F.col("p") >= rows), "walks")).limit(1).count():
        steps, outer = steps + 1, permute_once(outer, "p", rows, seed)
    return steps


def permute(df: DataFrame, place: str, rows: int, seed: int) -> DataFrame:
    """A permutation of the numbers 0 to rows-1 in column `place`, the same for the same rows and seed."""
    steps = walk_length(df.sparkSession, rows, seed)
    df = permute_once(df, place, rows, seed)
    for _ in range(steps):
        df = permute_once(df, place, rows, seed, only_outside=True)
    return df


def numbered(df: DataFrame, keys: list[str], number: str) -> tuple[DataFrame, int]:
    """Rows with their place in the order of `keys`, and the number of rows.

    A range shuffle sorts; every sorted piece counts from its own start and starts are running totals over the pieces.
    Rows that are equal in all keys are dealt by their place in the input, so no group of equal rows stays in one task.
    """
    spark = df.sparkSession
    held = cut(df.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    ordered = held.orderBy(*keys, "_tie").drop("_tie")
    # The upper bits of the id are the piece, the lower 33 the place within it.
    ordered = cut(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumns({"_piece": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = ordered.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_piece")) - F.col("_n"))
    starts = cut(starts, "starts")
    rows = starts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = ordered.join(starts.select("_piece", "_start"), "_piece")
    return out.withColumn(number, F.col("_start") + F.col("_at")).drop("_id", "_piece", "_at", "_start"), rows


def shard_documents(df: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, size, text_crc32, law, shard, slot, grown_shard of every row.

    Rows are numbered by (id, checksum, size); the permuted number modulo `shards` is the shard, its quotient the slot,
    so shards differ by one row at most and slots have no gaps. Null ids come first; a null text has size 1 and the
    checksum of no bytes; repeated rows are dealt like others; an empty table gives an empty one; other columns are not read.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                     F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows, total = numbered(slim, ["id", "text_crc32", "size"], "place")
    dealt = permute(rows, "place", total, seed) if total else rows
    return dealt.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

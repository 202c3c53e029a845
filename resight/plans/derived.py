"""Derived tables that stay in place: rows of deleted annotations go, and only the files that hold them are written anew.

A stored table is a folder of parts, named by a hash of its first annotation column. Beside it lies a helper table
(aid, part), laid out by a hash of the annotation, that tells which parts name an annotation in any of its columns.

Nulls name nothing and are never deleted. A delete may be run again after it was lost halfway: the helper learns
of new rows before they are written and forgets ids after their rows are gone, so it may name a part too many, never one too few.
One writer at a time. Columns may have any names but `_part`, `_spot` and `_gone`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.plans.snapshots import incremental_refresh
from resight.session import cut

PART, SPOT = "_part", "_spot"


def _hashed(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(parts)).cast("int")


def _write(rows: DataFrame, place: str, by: str, mode: str) -> None:
    """Parts of any size: those that are large are dealt to several tasks, small ones share a task."""
    rows.hint("rebalance", by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(place)


def _helper(rows: DataFrame, columns: list[str], parts: int) -> DataFrame:
    named = rows.select(PART, F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("aid"))
    return named.filter("aid is not null").distinct().withColumn(SPOT, _hashed("aid", parts))


def _add(table: DataFrame, place: str, columns: list[str], parts: int) -> None:
    rows = table.withColumn(PART, _hashed(columns[0], parts))
    _write(_helper(rows, columns, parts), f"{place}/helper", SPOT, "append")
    _write(rows, f"{place}/rows", PART, "append")


def _parts(spark: SparkSession, place: str) -> int:
    return spark.read.parquet(f"{place}/parts").first()["parts"]


def create_derived(table: DataFrame, place: str, columns: list[str], parts: int = 256) -> None:
    """Store a table under a fresh path; `columns` hold annotation ids. The number of parts is kept beside the table."""
    table.sparkSession.range(1).select(F.lit(parts).alias("parts")).write.mode("errorifexists").parquet(f"{place}/parts")
    _add(table, place, columns, parts)


def append_derived(table: DataFrame, place: str, columns: list[str]) -> None:
    """Add rows to a stored table."""
    _add(table, place, columns, _parts(table.sparkSession, place))


def read_derived(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(f"{place}/rows").drop(PART)


def _drop_folders(spark: SparkSession, place: str, by: str, values: list[int]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for value in values:
        folder = path(f"{place}/{by}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _numbers(rows: DataFrame, column: str) -> list[int]:
    """At most one number per part."""
    return sorted(r[0] for r in rows.select(column).distinct().collect())


def _rewrite(spark: SparkSession, place: str, by: str, touched: list[int], keep: Callable[[DataFrame], DataFrame]) -> None:
    def kept() -> DataFrame:
        stored = spark.read.parquet(place)
        return keep(stored.filter(F.col(by).isin(touched))).select(*stored.columns)

    _write(kept(), place, by, "overwrite")
    # A part without rows left is not among those overwritten.
    _drop_folders(spark, place, by, sorted(set(touched) - set(_numbers(kept(), by))))


def delete_stored(spark: SparkSession, place: str, columns: list[str], aids: DataFrame) -> list[int]:
    """Delete the rows that name one of aids(aid) in any of `columns`; returns the parts that were written anew."""
    gone = aids.select(F.col("aid").cast("string").alias("_gone")).filter("_gone is not null").distinct()
    spots = _numbers(gone.select(_hashed("_gone", _parts(spark, place)).alias(SPOT)), SPOT)
    helper = spark.read.parquet(f"{place}/helper")
    named = helper.filter(F.col(SPOT).isin(spots)).join(gone, F.col("aid") == F.col("_gone"))
    touched = _numbers(named, PART)
    if not touched:
        return []

    def without(*names: str) -> Callable[[DataFrame], DataFrame]:
        def keep(rows: DataFrame) -> DataFrame:
            for name in names:
                rows = rows.join(gone, F.col(name).cast("string") == F.col("_gone"), "left_anti")
            return rows

        return keep

    _rewrite(spark, f"{place}/rows", PART, touched, without(*columns))
    _rewrite(spark, f"{place}/helper", SPOT, spots, without("aid"))
    return touched


def refresh_stored(
    spark: SparkSession, inputs: DataFrame, place: str, keys: list[str], columns: list[str], fn: Callable[[DataFrame], DataFrame]
) -> None:
    """Append `fn` of the inputs whose keys are not stored yet; of the stored rows only the keys are read."""
    append_derived(cut(incremental_refresh(inputs, read_derived(spark, place), keys, fn), "fresh"), place, columns)

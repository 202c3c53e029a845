"""Stored results: which snapshot to use, what to delete, what is still to compute."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import text
from resight.operators.stored_index import StoredIndex, read_index
from resight.params import SnapshotParams


def snapshot_actions(catalogue: DataFrame, now: Column, params: SnapshotParams = SnapshotParams()) -> DataFrame:
    """catalogue(snapshot_id, tag, created) with its age in hours and 'expire' or 'keep'."""
    age = text.hours_between(now, F.col("created"))
    aged = catalogue.withColumn("age_hours", age)
    return aged.withColumn("action", F.when(F.col("age_hours") > params.expire_hours, "expire").otherwise("keep"))


def latest_snapshot(
    catalogue: DataFrame, now: Column, wanted: DataFrame | None = None, params: SnapshotParams = SnapshotParams()
) -> DataFrame:
    """(tag, snapshot_id, action): reuse the newest young snapshot of each tag, else create one.

    Snapshots past their time are listed with action 'expire'. `wanted(tag)` defaults to every
    tag of the catalogue.
    """
    aged = snapshot_actions(catalogue, now, params)
    tags = catalogue.select("tag").distinct() if wanted is None else wanted.select("tag").distinct()
    young = aged.filter(F.col("age_hours") <= params.reuse_hours)
    newest = young.groupBy("tag").agg(F.max(F.struct("created", "snapshot_id")).alias("_s"))
    chosen = tags.join(newest, "tag", "left").select(
        "tag", F.col("_s.snapshot_id").alias("snapshot_id"),
        F.when(F.col("_s").isNotNull(), "reuse").otherwise("create").alias("action"),
    )
    return chosen.unionByName(aged.filter(F.col("action") == "expire").select("tag", "snapshot_id", "action"))


def config_tag(config: dict) -> str:
    """Fingerprint of the settings that matter, whatever their order."""

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def publish(frame: DataFrame, folder: str, tag: str, created: str, partition_by: list[str] | None = None) -> str:
    """Write a snapshot under its own path; a reader sees it once the path is in the catalogue."""
    place = f"{folder}/tag={tag}/created={created}"
    writer = frame.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(place)
    return place


def load_or_create(
    spark: SparkSession, catalogue: DataFrame, tag: str, now: Column, folder: str, created: str,
    make: Callable[[], DataFrame], params: SnapshotParams = SnapshotParams(),
) -> DataFrame:
    """Read the young snapshot of a tag, or compute and publish one. snapshot_id is its path."""
    place = _young(spark, catalogue, tag, now, params) or publish(make(), folder, tag, created)
    return spark.read.parquet(place)


def _young(spark: SparkSession, catalogue: DataFrame, tag: str, now: Column, params: SnapshotParams) -> str | None:
    wanted = spark.createDataFrame([(tag,)], "tag string")
    row = latest_snapshot(catalogue, now, wanted, params).filter("action = 'reuse'").first()
    return row["snapshot_id"] if row else None


def load_or_build_index(
    spark: SparkSession, catalogue: DataFrame, tag: str, now: Column, folder: str, created: str,
    build: Callable[[str], StoredIndex], params: SnapshotParams = SnapshotParams(),
) -> tuple[StoredIndex, str]:
    """The young search index of a tag and its path, or a new one that `build(path)` writes."""
    place = _young(spark, catalogue, tag, now, params)
    if place:
        return read_index(spark, place), place
    place = f"{folder}/tag={tag}/created={created}"
    return build(place), place


def delete_derived(tables: dict[str, tuple[DataFrame, list[str]]], aids: DataFrame) -> dict[str, DataFrame]:
    """Surviving rows of each table; a row goes if any of its annotation columns is listed."""
    out = {}
    for name, (table, columns) in tables.items():
        kept = table
        for column in columns:
            kept = kept.join(aids.select(F.col("aid").alias(column)).distinct(), column, "left_anti")
        out[name] = kept.select(*table.columns)
    return out


def incremental_refresh(
    inputs: DataFrame, existing: DataFrame, keys: list[str], fn: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """New rows only: `fn` over the inputs whose keys are not stored yet."""
    return fn(inputs.join(existing.select(*keys).distinct(), keys, "left_anti"))

"""Readers and writers of observation rosters: impath, individual, encounter, side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import text
from resight.operators.tiles import dense_index

ROSTER = ["impath", "individual", "encounter", "side"]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def full_roster(spark: SparkSession, path: str) -> DataFrame:
    """CSV with at least Filepath, Individual, Encounter and Side; further columns are not parsed."""
    listed = spark.read.option("header", True).csv(path)
    return listed.select("Filepath", "Individual", "Encounter", "Side").toDF(*ROSTER)


def numbered_encounters(rows: DataFrame, order: str, bucket: Column) -> DataFrame:
    """Each row is its own encounter, numbered from 0 in file order."""
    one = rows.withColumn("_all", F.lit(0))
    return dense_index(one, ["_all"], [order], bucket, out="encounter").drop("_all")


def path_roster(paths: DataFrame, path: str = "path") -> DataFrame:
    """Roster from /…/individual/encounter/file; only finished encounters; all views are left."""
    parts = F.split(F.col(path), "/")
    split = paths.select(
        F.col(path).alias("impath"),
        F.element_at(parts, -3).alias("individual"),
        F.element_at(parts, -2).alias("encounter"),
        F.lit("Left").alias("side"),
    )
    return split.filter(text.finished_encounter(F.col("encounter")))


def folder_roster(spark: SparkSession, folder: str) -> DataFrame:
    """List files below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return path_roster(files)


def union_rosters(named: dict[str, DataFrame]) -> DataFrame:
    """Union of rosters; the source name goes before the encounter, so sources do not mix."""
    out = None
    for name, roster in named.items():
        part = roster.select(
            "impath", "individual", F.concat_ws(":", F.lit(name), F.col("encounter").cast("string")).alias("encounter"),
            "side",
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_roster(roster: DataFrame, path: str) -> None:
    roster.select(*ROSTER).write.mode("errorifexists").option("header", True).csv(path)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ", ".join(f"{c} string" for c in ROSTER))


class RosterReaders:
    """Readers by short name."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, reader: Callable[[], DataFrame]) -> None:
        self._readers[name] = reader

    def load(self, name: str) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"no roster named {name}; known: {sorted(self._readers)}")
        return self._readers[name]()


def annotations(roster_ids: DataFrame, annots: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Attributes of the given aids by key join instead of positional look-up."""
    out = roster_ids.join(annots, "aid")
    return out if names is None else out.join(names, "nid")


def image_sets(sets: DataFrame, wanted: list[str] | DataFrame, annots: DataFrame) -> DataFrame:
    """Annotations of the named sets; sets(set_name, aid)."""
    if isinstance(wanted, DataFrame):
        chosen = sets.join(wanted.select("set_name").distinct(), "set_name", "left_semi")
    else:
        chosen = sets.filter(F.col("set_name").isin(*wanted))
    return chosen.join(annots, "aid")


def read_catalogue(spark: SparkSession, tables: dict[str, str], fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Catalogue tables by name from files or, with fmt='jdbc', from a database table each."""
    out = {}
    for name, place in tables.items():
        reader = spark.read.format(fmt).options(**options)
        out[name] = reader.option("dbtable", place).load() if fmt == "jdbc" else reader.load(place)
    return out


def star_join(fact: DataFrame, lookups: list[tuple[DataFrame, Column | str | list[str], str]]) -> DataFrame:
    """Join look-ups to a fact in order. Catalyst picks broadcast or shuffle from their sizes."""
    out = fact
    for table, on, how in lookups:
        out = out.join(table, on, how)
    return out

"""Stored series, vectors, training lists and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import text
from resight.operators import series as S
from resight.operators.tiles import tile_of


def _parts(spark: SparkSession, *keys: Column) -> Column:
    """Part number of a row; as many parts as the session has shuffle partitions."""
    return F.pmod(F.xxhash64(*keys), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def write_scales(series: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per scale. A failed contour keeps a row with a null value.

    Rows are laid out by (scale, contour tile): each folder gets several files, and neither a scale
    nor a contour that holds most rows is written by one task.
    """
    keyed = series.withColumn("scale_key", text.scale_key(F.col("scale"))).drop("scale")
    part = _parts(series.sparkSession, F.col("contour_id"), tile_of(F.coalesce("idx", F.lit(0))))
    keyed.repartition(F.col("scale_key"), part).write.mode(mode).partitionBy("scale_key").parquet(path)


def read_scales(
    spark: SparkSession, path: str, scales: list[float], length: int | None = None, schema: str | None = None,
) -> DataFrame:
    """Only the folders of the wanted scales are read; series of another length are resampled."""
    keys = [f"{s:.3f}" for s in scales]
    reader = spark.read.schema(schema) if schema else spark.read
    stored = reader.parquet(path).withColumn("scale_key", F.format_string("%.3f", F.col("scale_key").cast("double")))
    wanted = stored.filter(F.col("scale_key").isin(*keys)).filter(F.col("value").isNotNull())
    if length is None:
        return wanted
    return S.resample(wanted, length, ["contour_id", "scale_key"], ["value"], keep_if_equal=True)


def write_vectors(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    keyed = vectors.withColumn("scale_key", F.col("scale").cast("string")).drop("scale")
    part = _parts(vectors.sparkSession, F.col("vec_id"))
    keyed.repartition(F.col("scale_key"), part).write.mode(mode).partitionBy("scale_key").parquet(path)


def read_vectors(spark: SparkSession, path: str, scales: list[str] | None = None) -> DataFrame:
    stored = spark.read.parquet(path).withColumn("scale", F.col("scale_key").cast("string"))
    if scales is not None:
        stored = stored.filter(F.col("scale").isin(*scales))
    return stored.drop("scale_key")


TRAINING = "Image string, Name string, Contour string, Train int"


def write_training_list(rows: DataFrame, path: str) -> None:
    listed = rows.select(
        F.col("image").alias("Image"), F.col("name").alias("Name"), F.col("contour_id").cast("string").alias("Contour"),
        F.col("is_train").cast("int").alias("Train"),
    )
    listed.write.mode("errorifexists").option("header", True).csv(path)


def read_training_list(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(TRAINING).option("header", True).csv(path)
    return raw.select(
        F.col("Image").alias("image"), F.col("Name").alias("name"), F.col("Contour").alias("contour_id"),
        (F.col("Train") == 1).alias("is_train"),
    )


def write_evaluation(frames: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per evaluation table; returns the folders."""
    places = {}
    for name, frame in frames.items():
        places[name] = f"{path}/{name}"
        frame.write.mode("errorifexists").format(fmt).save(places[name])
    return places


def missing_inputs(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs with no stored output."""
    return inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def missing_scales(inputs: DataFrame, outputs: DataFrame, scales: Column, key: str = "obs_id") -> DataFrame:
    """(input, scale) pairs requested but not stored; `scales` is a short array column."""
    wanted = inputs.select(key, F.explode(scales).alias("scale"))
    return wanted.join(outputs.select(key, "scale").distinct(), [key, "scale"], "left_anti")

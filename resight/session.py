"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "resight", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="resight-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_dir(spark)}/resight-{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once nothing that reads them is still to run."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    own = shared_dir(spark).rstrip("/").removeprefix("file://").removeprefix("file:")
    for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        if f"{own}/resight-" in folder:
            place = hadoop(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage with a table written to the shared folder.

    Unlike a checkpointed RDD the table is computed once and keeps its size, from which the
    planner picks join strategies.
    """
    spark = df.sparkSession
    place = scratch_path(spark, label)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def cut_and_observe(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """As `cut`, with aggregates taken while the table is written."""
    seen = Observation()
    return cut(df.observe(seen, *metrics), label), seen.get

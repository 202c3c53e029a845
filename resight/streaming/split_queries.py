"""Score queries whose vectors arrive over several batches.

Two streams: the first finds the evidence of every micro-batch against a stored database and appends it, summed by query
and target, to a folder; the second sums what arrives per query in keyed state, and answers once a query's end mark has
come or nothing has come for a while. Evidence is additive over vectors, so the sum is the score of the whole query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from resight.operators import evidence as E
from resight.operators.neighbours import neighbours
from resight.params import LnbnnParams

#: The state store that keeps one entry per target; a session sets it before it starts the second stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def evidence_schema(query_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("target_id", T.StringType()),
                         T.StructField("score", T.DoubleType()), T.StructField("last", T.BooleanType())])


def evidence_batch(database: Callable[[], DataFrame], folder: str, params: LnbnnParams = LnbnnParams()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over (query_id, scale, vec_id, vec, last): evidence by query and target, and end marks.

    A batch that was written to its end is not written again when it is replayed.
    """
    target = "label" if params.level == "name" else "owner"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch_id}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        stored = database().select("scale", "vec_id", "vec", F.col(target).alias("target"))
        asked = batch.select("query_id", "scale", "vec_id", "vec")
        found = E.total_scores(E.evidence(neighbours(asked, stored, params.k + 1, params.method, params.neighbours)))
        rows = found.select("query_id", F.col("target_id").cast("string").alias("target_id"), "score", F.lit(False).alias("last"))
        marks = batch.where("last").select(
            "query_id", F.lit(None).cast("string").alias("target_id"), F.lit(0.0).alias("score"), F.lit(True).alias("last")).distinct()
        rows.unionByName(marks).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return run


def stream_evidence(
    queries: DataFrame, database: Callable[[], DataFrame], folder: str, checkpoint: str, params: LnbnnParams = LnbnnParams(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the first stream; the vectors of a query may lie in any batches, `last` is true on one that ends it."""
    writer = queries.writeStream.foreachBatch(evidence_batch(database, folder, params))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class EvidenceSums(StatefulProcessor):
    """Per query: the sum for every target seen so far; one answer on the end mark, or `wait` milliseconds after the last row."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "target_id string", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = False
        for part in rows:
            ended |= bool(part["last"].any())
            found = part[part["target_id"].notna()].groupby("target_id")["score"].sum()
            for target, score in found.items():
                held = self.sums.getValue((target,)) if self.sums.containsKey((target,)) else (0.0,)
                self.sums.updateValue((target,), (held[0] + float(score),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            yield self.answer(key)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
            yield self.answer(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.answer(key)

    def answer(self, key, rows: list | None = None) -> pd.DataFrame:
        """All sums of a query, which are forgotten then; or the rows given."""
        if rows is None:
            rows = [(key[0], target[0], score[0]) for target, score in self.sums.iterator()]
            self.sums.clear()
        return pd.DataFrame(rows, columns=["query_id", "target_id", "score"])

    def close(self) -> None:
        pass


def stream_totals(
    spark: SparkSession, folder: str, out: str, checkpoint: str, query_type: T.DataType, wait: int = 60_000,
    params: LnbnnParams = LnbnnParams(), trigger: dict | None = None,
) -> StreamingQuery:
    """Start the second stream: (query_id, target_id as text, score) of every answered query, appended to `out`.

    It runs until it is stopped: timers need batches without data, which a trigger that ends with the data never stops
    making. Rows that come after a query was answered begin a new answer. Only scores below the least one are written; at level
    'annotation' not that of the query itself.
    """
    arriving = spark.readStream.schema(evidence_schema(query_type)).parquet(f"{folder}/*")
    schema = T.StructType(evidence_schema(query_type).fields[:3])
    summed = arriving.groupBy("query_id").transformWithStateInPandas(
        EvidenceSums(wait), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
    kept = summed.where(F.col("score") < params.minimum_score)
    if params.level == "annotation":
        kept = kept.where(F.col("target_id") != F.col("query_id").cast("string"))
    writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()

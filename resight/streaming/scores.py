"""Score query vectors that arrive as a stream against a stored database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from resight.params import LnbnnParams
from resight.plans.scoring import lnbnn_scores


def score_batch(
    database: Callable[[], DataFrame], folder: str, params: LnbnnParams = LnbnnParams()
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; a replayed batch overwrites its own folder."""

    def run(batch: DataFrame, batch_id: int) -> None:
        scores = lnbnn_scores(batch, database(), params)
        scores.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return run


def stream_scores(
    queries: DataFrame, database: Callable[[], DataFrame], folder: str, checkpoint: str,
    params: LnbnnParams = LnbnnParams(), trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream. All vectors of a query must arrive in one batch (one file per query set)."""
    writer = queries.writeStream.foreachBatch(score_batch(database, folder, params))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

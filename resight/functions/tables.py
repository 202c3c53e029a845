"""Table functions for SQL: keypoint pairs of series, and warped distances of listed pairs.

    register_tables(spark)
    SELECT * FROM keypoint_pairs(TABLE(SELECT contour_id, scale, idx FROM keypoints) PARTITION BY (contour_id, scale))
    SELECT * FROM warped_distances(TABLE(SELECT pair_id, a, b FROM pairs), 'chi_square', 8, 2)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from resight.operators.warping import cost_function, warp

MOST_KEYPOINTS = 4096


@udtf(returnType="contour_id bigint, scale double, idx0 int, idx1 int")
class KeypointPairs:
    """All pairs idx0 < idx1 of the keypoints (contour_id, scale, idx) of a partition, which is one series.

    Keypoints are bounded by a parameter of their selection; a partition beyond that is refused, not cut. Rows without an
    index are left out, repeated ones count once.
    """

    def __init__(self):
        self.key, self.places = None, set()

    def eval(self, row):
        self.key = (row["contour_id"], row["scale"])
        if row["idx"] is not None:
            self.places.add(row["idx"])
        if len(self.places) > MOST_KEYPOINTS:
            raise ValueError("PARTITION BY the series: too many keypoints in one partition")

    def terminate(self):
        places = sorted(self.places)
        for at, first in enumerate(places):
            for second in places[at + 1 :]:
                yield (*self.key, first, second)


@udtf(returnType="pair_id bigint, distance double")
class WarpedDistances:
    """The warped distance of every row (pair_id, a, b): flat series of equal length; null where one of them is null."""

    def eval(self, row, cost: str, window: int, channels: int):
        if row["a"] is None or row["b"] is None:
            yield row["pair_id"], None
            return
        if len(row["a"]) != len(row["b"]) or len(row["a"]) % channels:
            raise ValueError("series of different lengths")
        a, b = (np.array(row[c], dtype=float).reshape(-1, channels).T[..., None] for c in ("a", "b"))
        yield row["pair_id"], float(warp(a, b, np.ones(a.shape[1]), window, cost_function(cost))[0])


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("keypoint_pairs", KeypointPairs)
    spark.udtf.register("warped_distances", WarpedDistances)

"""Report on a roster: how many images and encounters, and how many contours succeeded."""

from __future__ import annotations

from pyspark.sql import DataFrame

from resight.operators import splits


def catalogue_report(roster: DataFrame, status: DataFrame) -> DataFrame:
    """(bin, images_density, encounters_density, n_success, n_total)."""
    counts = splits.success_report(status)
    return splits.encounter_statistics(roster).withColumns(
        {c: counts.select(c).scalar() for c in ("n_success", "n_total")}
    )

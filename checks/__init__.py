"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from checks import (  # noqa: F401
    q_aggregates, q_defaults, q_filters, q_joins, q_plans, q_scalars, q_series, q_sources, q_windows,
)
from checks.registry import ORACLES, QUERIES  # noqa: F401

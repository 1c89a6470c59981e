"""All registered queries: importing the modules registers them."""

from borehole.plans import (  # noqa: F401
    anomaly_queries,
    geo_queries,
    model_queries,
    series_queries,
    table_queries,
)
from borehole.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

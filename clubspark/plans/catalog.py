"""Imports every query module, so that the registry is full."""

from clubspark.plans import (  # noqa: F401
    booking_queries,
    cleaning_queries,
    loading_queries,
    model_queries,
    report_queries,
    statistics_queries,
    streaming_queries,
)
from clubspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

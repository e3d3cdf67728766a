"""Operators of ``gridpanel`` applied to the driver's tables, with their SQL twins."""

from driver_queries import (  # noqa: F401
    clean_queries,
    describe_queries,
    draw_queries,
    ensemble_queries,
    market_queries,
    source_queries,
)
from driver_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

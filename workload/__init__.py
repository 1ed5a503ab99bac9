"""Registered queries: the package's operators over the given tables, with SQL to check them."""

from workload import chain, graph, journeys, pricing, surfaces, transfers, web  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

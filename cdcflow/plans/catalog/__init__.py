"""Registered queries over the given tables, each beside the SQL that checks it."""

from cdcflow.plans.catalog import care, feed, fleet, keys, measures, quality, runs, versions  # noqa: F401
from cdcflow.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Importing this package registers all queries."""

from . import aggregates, graphs, incremental, joins, ordering, pairs_stats, scalars, sources, streams, study  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

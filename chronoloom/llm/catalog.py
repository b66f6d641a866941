"""Importing this module registers all queries of the subpackage."""

from . import free_queries, native_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

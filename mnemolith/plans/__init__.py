"""Registered queries with their SQL."""

from . import upkeep  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

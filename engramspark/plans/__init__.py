"""All registered queries of the memory graph."""

from . import extras, graph, ranking, sessions, state, tables, upkeep, writes  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

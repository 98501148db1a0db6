"""Queries over the given tables, one module per part of the operator inventory."""

from leafwright.bindings import (  # noqa: F401
    aggregates,
    filters,
    graphs,
    joins,
    scalars,
    sets,
    sources,
    updates,
    windows,
)
from leafwright.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

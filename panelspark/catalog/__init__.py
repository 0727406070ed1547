"""Runnable queries, one per operator, each with the SQL that gives the same rows."""

from panelspark.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "load"]


def load() -> None:
    """Import every query module, which fills the registry."""
    from panelspark.catalog import (clean, estimators, groups, joins, models, network,  # noqa: F401
                                    ordered, scalars, sources, stats)

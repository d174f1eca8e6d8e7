"""Registered queries and the SQL that checks them."""

from importlib import import_module

AREAS = ["fleet", "series", "measures", "texts", "rules", "reports", "alerts", "memory", "ingest", "streams", "raising"]


def load():
    """Import every area once; returns the queries and their check SQL."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    from .base import ORACLES, QUERIES

    return QUERIES, ORACLES

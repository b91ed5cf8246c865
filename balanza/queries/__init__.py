"""Registered queries: each has a Spark form and, where SQL can say it, an oracle text."""

import importlib

from balanza.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "load_all"]

FAMILIES = ("statements", "documents", "scalars", "series", "finance", "people", "layout", "reports", "streams")


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"balanza.queries.{family}")

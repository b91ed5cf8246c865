"""Plan helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def settle(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters read as values.

    A filter on a column with a long expression is otherwise moved below the projection with the
    whole expression copied into it, so the expression runs twice and without shared parts.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))

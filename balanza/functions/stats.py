"""Least squares on exact sums.

Amounts are summed as whole cents, so slope and intercept do not depend on row order or on how
the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

CENTS = "decimal(38,0)"


def line(x: Column, y: Column, over: WindowSpec | None = None) -> tuple[Column, Column]:
    """(slope, intercept) of money ``y`` on whole-number ``x``, as aggregates or over a window.

    Rows where ``x`` or ``y`` is NULL are left out. The slope is NULL when all ``x`` are equal.
    """
    def total(c: Column) -> Column:
        return F.sum(c) if over is None else F.sum(c).over(over)

    both = x.isNotNull() & y.isNotNull()
    cents = F.when(both, F.round(y * 100).cast(CENTS))
    place = F.when(both, x.cast("bigint"))
    n, sx, sxx = total(F.when(both, F.lit(1))), total(place), total(place * place)
    sy, sxy = total(cents), total((cents * place).cast(CENTS))
    den = n * sxx - sx * sx
    num = (n * sxy).cast(CENTS) - (sx * sy).cast(CENTS)
    slope = F.try_divide(num.cast("double"), (den * 100).cast("double"))
    intercept = (sy.cast("double") / F.lit(100.0) - slope * sx) / n
    return slope, intercept

"""Arithmetic with the engine's rules for missing and undefined values.

A NaN becomes null where data enter (``known``), so that aggregates skip it; infinite
values stay.  "Undefined" results are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """As a double, with NaN as null."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """Null unless finite."""
    return F.when(F.abs(x) < INF, x)


def at_least(x: Column, low: float) -> Column:
    """max(x, low), null where x is."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """Bounded; a bound of None does not bound, a null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def mean_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom for means: infinite for a positive over zero, null for zero over zero."""
    return F.when(bottom == 0, F.when(top > 0, F.lit(INF))).otherwise(F.try_divide(top, bottom))


def strict_avg(x: Column) -> Column:
    """Aggregate: the mean, null if any member is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def gmean(x: Column) -> Column:
    """Aggregate: the geometric mean of non-negative values, 0 if any is 0, null if any is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.when(F.min(x) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(x)))))


def log1p(x: Column) -> Column:
    """ln(1 + x): minus infinity at -1, null below."""
    return F.when(x == -1, F.lit(-INF)).when(x > -1, F.log1p(x))


def quantile_loss(y: Column, q: Column, level: float) -> Column:
    """2 |(y - q) (1[y <= q] - level)|."""
    return 2 * F.abs((y - q) * (F.when(y <= q, 1.0).otherwise(0.0) - level))

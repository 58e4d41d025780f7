"""Functions of one series held as arrays: no shuffle, whatever the number of series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, known


def bind(value: Column, f) -> Column:
    """f(value) with the value made once."""
    return F.transform(F.array(value), f)[0]


def cutoff_index(length: Column, cutoff: Column) -> Column:
    """Number of past steps for an integer cutoff: from the end if negative, clipped."""
    return F.greatest(F.lit(0), F.least(length, F.when(cutoff >= 0, cutoff).otherwise(length + cutoff)))


def cutoff_index_at(timestamps: Column | str, cutoff: Column) -> Column:
    """Number of past steps for a timestamp cutoff (inclusive)."""
    return F.size(F.filter(col(timestamps), lambda t: t <= cutoff))


def lagged(values: Column | str, lag: int, f) -> Column:
    """f(x[t], x[t - lag]) for t = lag, lag + 1, ...; empty if the series is too short."""
    v = col(values)
    n = F.size(v) - lag
    return F.when(n > 0, F.zip_with(F.slice(v, F.lit(lag + 1), n), F.slice(v, F.lit(1), n), f)).otherwise(F.slice(v, 1, 0))


def seasonal_error(values: Column | str, season: int, square: bool = False) -> Column:
    """Mean |x[t] - x[t - season]| (or its square) over known pairs, null if there is none."""
    error = (lambda a, b: (a - b) * (a - b)) if square else (lambda a, b: F.abs(a - b))
    doubles = F.transform(col(values), lambda x: known(x))
    pairs = F.filter(lagged(doubles, season, error), lambda x: x.isNotNull())
    return bind(pairs, lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, b: a + b) / F.size(p)))


def tail(values: Column | str, n: int) -> Column:
    """The last n values, or all."""
    v = col(values)
    return F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), F.lit(n))


def forward_fill(values: Column | str) -> Column:
    """Each missing value replaced by the last known before it; leading ones stay missing."""
    v = F.transform(col(values), lambda x: known(x))
    filled = F.aggregate(v, F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last")), lambda s, x: F.struct(F.array_append(s["out"], F.coalesce(x, s["last"])).alias("out"), F.coalesce(x, s["last"]).alias("last")))
    return filled["out"]


def backward_fill(values: Column | str) -> Column:
    """Each missing value replaced by the next known; trailing ones stay missing."""
    return F.reverse(forward_fill(F.reverse(col(values))))


def fill(values: Column | str, otherwise: float = 0.0) -> Column:
    """Forward, then backward, then ``otherwise``: for models that need complete series."""
    return F.transform(backward_fill(forward_fill(values)), lambda x: F.coalesce(x, F.lit(float(otherwise))))


def left_pad(values: Column | str, n: int) -> Column:
    """Nulls in front, up to length n."""
    v = col(values)
    return F.when(F.size(v) < n, F.concat(F.array_repeat(F.lit(None).cast("double"), F.lit(n) - F.size(v)), F.transform(v, lambda x: known(x)))).otherwise(F.transform(v, lambda x: known(x)))


def ewm(values: Column | str, alpha: float) -> Column:
    """Exponentially weighted mean s[t] = (1 - alpha) s[t-1] + alpha x[t], s[0] = x[0]."""
    v = F.transform(col(values), lambda x: known(x))
    out = F.aggregate(v, F.array().cast("array<double>"), lambda s, x: F.array_append(s, F.coalesce(F.when(F.size(s) == 0, x).otherwise((1 - alpha) * F.element_at(s, -1) + alpha * x), F.when(F.size(s) > 0, F.element_at(s, -1)))))
    return out


def mean(values: Column | str) -> Column:
    v = F.filter(F.transform(col(values), lambda x: known(x)), lambda x: x.isNotNull())
    return bind(v, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)))


def local_scale(values: Column | str) -> Column:
    """(x - mean) / sample standard deviation of the series; null for a constant series."""
    v = F.transform(col(values), lambda x: known(x))

    def scaled(m):
        squares = F.filter(F.transform(v, lambda x: (x - m) * (x - m)), lambda x: x.isNotNull())
        deviation = bind(squares, lambda a: F.when(F.size(a) > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / (F.size(a) - 1))))
        return bind(deviation, lambda d: F.transform(v, lambda x: F.try_divide(x - m, d)))

    return bind(mean(values), scaled)


def non_negative(values: Column | str) -> Column:
    """True if no known value is below zero."""
    return F.forall(col(values), lambda x: F.coalesce(x >= 0, F.lit(True)))


def clamp_like(context: Column | str, forecast: Column | str) -> Column:
    """The forecast, not below zero if the context never is."""
    return F.when(non_negative(context), F.transform(col(forecast), lambda x: F.greatest(x, F.lit(0.0)))).otherwise(col(forecast))

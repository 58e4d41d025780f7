"""Baseline forecasts as expressions over each series' history."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.numeric import col, known


def naive(history: Column, horizon: int) -> Column:
    """The last known value."""
    last = series.bind(F.filter(F.transform(history, lambda x: known(x)), lambda x: x.isNotNull()), lambda v: F.try_element_at(v, F.lit(-1)))
    return F.array_repeat(last, horizon)


def seasonal_naive(history: Column, horizon: int, season: int) -> Column:
    """The value one season before; the last value for a series shorter than a season."""
    n = F.size(history)
    seasonal = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: known(F.get(history, n - season + h % season)))
    return F.when(n >= season, seasonal).otherwise(naive(history, horizon))


def drift(history: Column, horizon: int) -> Column:
    """A straight line through the first and the last value."""
    n = F.size(history)
    first, last = known(F.get(history, F.lit(0))), known(F.get(history, n - 1))
    slope = F.coalesce(F.try_divide(last - first, (n - 1).cast("double")), F.lit(0.0))
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: last + h * slope)


def average(history: Column, horizon: int) -> Column:
    return F.array_repeat(series.mean(history), horizon)


def capped_season(season: int, max_context: int | None, max_season: int | None = None) -> int:
    """1 where a season would not fit the context."""
    return 1 if (max_context is not None and season > max_context) or (max_season is not None and season > max_season) else season


METHODS: dict[str, Callable[..., Column]] = {"naive": lambda y, h, s: naive(y, h), "seasonal_naive": seasonal_naive, "drift": lambda y, h, s: drift(y, h), "average": lambda y, h, s: average(y, h)}


def residual_quantiles(history: Column, points: Column, season: int, levels: Sequence[float]) -> list[Column]:
    """Forecast quantiles: the points plus linear-interpolated quantiles of the
    differences at the seasonal lag (0 where there are none)."""
    doubles = F.transform(history, lambda x: known(x))
    errors = F.sort_array(F.filter(series.lagged(doubles, season, lambda a, b: a - b), lambda x: x.isNotNull()))

    def quantile(level: float) -> Column:
        def of(e):
            at = (F.size(e) - 1) * F.lit(float(level))
            low = F.floor(at).cast("int")
            a, b = F.get(e, low), F.get(e, F.least(low + 1, F.size(e) - 1))
            return F.coalesce(a + (b - a) * (at - low), F.lit(0.0))

        return F.transform(points, lambda p: p + series.bind(errors, of))

    return [quantile(level) for level in levels]


def forecast(windows: DataFrame, method: str, targets: Sequence[str], horizon: int, season: int = 1, levels: Sequence[float] = (), id_column: str = "id", target_name: str = "target_name") -> DataFrame:
    """Nested forecasts of every window and target, from the windows' own rows (no shuffle)."""
    each = F.array(*(F.struct(F.lit(t).alias("name"), F.col("past").getField(t).cast("array<double>").alias("y")) for t in targets))
    rows = windows.select("window_idx", id_column, F.explode(each).alias("_t"))
    points = rows.withColumn("predictions", METHODS[method](F.col("_t.y"), horizon, season))
    return points.select("window_idx", F.col(id_column).alias("id"), F.col("_t.name").alias(target_name), "predictions", *(c.alias(str(level)) for c, level in zip(residual_quantiles(F.col("_t.y"), F.col("predictions"), season, levels), levels)))


def sample_quantiles(samples: DataFrame, by: Sequence[str], levels: Sequence[float], sample: str = "value") -> DataFrame:
    """Quantiles (linear interpolation) over sampled paths, an array in the levels' order."""
    return samples.groupBy(*by).agg(F.percentile(sample, F.array(*(F.lit(float(x)) for x in levels))).alias("quantiles"))


def nearest_level(level: float, available: Sequence[float]) -> float:
    """The model's quantile level that is closest (the lower of two)."""
    return min(sorted(available), key=lambda x: abs(x - level))


def interval_suffix(level: float) -> str:
    """The column suffix of a central interval's bound: 0.1 -> lo-80, 0.5 -> none."""
    width = round(abs(2 * level - 1) * 100, 4)
    text = f"{width:g}"
    return "" if level == 0.5 else f"-lo-{text}" if level < 0.5 else f"-hi-{text}"


#: Which statistic of a predictive distribution a metric wants as its point (fixed values).
POINT_STATISTIC = {"MSE": "mean", "RMSE": "mean", "RMSSE": "mean"}


def point_statistic(metric: str) -> str:
    return POINT_STATISTIC.get(metric.upper(), "median")


def context_tail(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, series.tail(col(c), n))
    return df

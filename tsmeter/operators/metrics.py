"""The fourteen accuracy metrics as aggregate expressions.

Input: one row for each (window, target, item, step) with ``y`` (truth), ``p`` (point
forecast), ``q_0``, ``q_1``, ... (a column for each quantile level) and the item's
seasonal errors ``scale_abs`` and ``scale_sq``.  All metrics and levels are computed in
one hash aggregate over (window, target), whose partial sums are combined before the
shuffle; what follows is tiny.  A score is the plain mean over targets, then levels,
then windows: one undefined member makes the mean undefined (null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import at_least, finite, log1p, mean_ratio, quantile_loss, strict_avg

Y, P, ABS, SQ = F.col, F.col, "scale_abs", "scale_sq"


class Metric:
    """A metric: aggregate expressions for one target.  Subclass it to add one."""

    name: str = ""
    needs_quantiles = False
    takes_epsilon = False

    def __init__(self, epsilon: float = 0.0):
        if epsilon and not self.takes_epsilon:
            raise ValueError(f"Metric {self.name} has no epsilon")
        self.epsilon = float(epsilon)

    def score(self, y: Column, p: Column) -> Column:
        """Point metrics: the aggregate."""
        raise NotImplementedError

    def level_score(self, y: Column, q: Column, level: float) -> Column:
        """Quantile metrics: the aggregate for one level."""
        raise NotImplementedError

    def columns(self, levels: Sequence[float]) -> list[Column]:
        y = F.col("y")
        if not self.needs_quantiles:
            return [self.score(y, F.col("p"))]
        if not levels:
            raise ValueError(f"{self.name} needs quantile_levels")
        return [self.level_score(y, F.col(f"q_{i}"), level) for i, level in enumerate(levels)]


def _mean_abs(y: Column) -> Column:
    return F.avg(F.abs(y))


class MAE(Metric):
    name = "MAE"

    def score(self, y, p):
        return F.avg(F.abs(y - p))


class MAEB(Metric):
    name = "MAEB"

    def score(self, y, p):
        return F.avg(F.abs(y - p)) + F.abs(F.avg(p - y))


class WAPE(Metric):
    name, takes_epsilon = "WAPE", True

    def score(self, y, p):
        return mean_ratio(F.avg(F.abs(y - p)), at_least(_mean_abs(y), self.epsilon))


class WAPEB(Metric):
    name, takes_epsilon = "WAPEB", True

    def score(self, y, p):
        return mean_ratio(F.avg(F.abs(y - p)) + F.abs(F.avg(p - y)), at_least(_mean_abs(y), self.epsilon))


class MASE(Metric):
    name, takes_epsilon = "MASE", True

    def score(self, y, p):
        return F.avg(finite(F.try_divide(F.abs(y - p), at_least(F.col(ABS), self.epsilon))))


class MSE(Metric):
    name = "MSE"

    def score(self, y, p):
        return F.avg((y - p) * (y - p))


class RMSE(Metric):
    name = "RMSE"

    def score(self, y, p):
        return F.sqrt(F.avg((y - p) * (y - p)))


class RMSSE(Metric):
    name, takes_epsilon = "RMSSE", True

    def score(self, y, p):
        return F.sqrt(F.avg(finite(F.try_divide((y - p) * (y - p), at_least(F.col(SQ), self.epsilon)))))


class RMSLE(Metric):
    name = "RMSLE"

    def score(self, y, p):
        d = log1p(y) - log1p(p)
        return F.sqrt(F.avg(F.nanvl(d * d, F.lit(None).cast("double"))))


class MAPE(Metric):
    name = "MAPE"

    def score(self, y, p):
        return F.avg(finite(F.try_divide(F.abs(y - p), F.abs(y))))


class SMAPE(Metric):
    name = "SMAPE"

    def score(self, y, p):
        return F.avg(finite(F.try_divide(2 * F.abs(y - p), F.abs(y) + F.abs(p))))


class MQL(Metric):
    name, needs_quantiles = "MQL", True

    def level_score(self, y, q, level):
        return F.avg(quantile_loss(y, q, level))


class SQL(Metric):
    name, needs_quantiles, takes_epsilon = "SQL", True, True

    def level_score(self, y, q, level):
        return F.avg(finite(F.try_divide(quantile_loss(y, q, level), at_least(F.col(ABS), self.epsilon))))


class WQL(Metric):
    name, needs_quantiles, takes_epsilon = "WQL", True, True

    def level_score(self, y, q, level):
        return mean_ratio(F.avg(quantile_loss(y, q, level)), at_least(_mean_abs(F.when(q.isNotNull(), y)), self.epsilon))


METRICS = {m.name.upper(): m for m in (MAE, MAEB, WAPE, WAPEB, MASE, MSE, RMSE, RMSSE, RMSLE, MAPE, SMAPE, MQL, SQL, WQL)}


def get_metric(metric: str | dict | Metric) -> Metric:
    """By name (any case) or as a dict with ``name`` and options such as ``epsilon``."""
    if isinstance(metric, Metric):
        return metric
    options = dict(metric) if isinstance(metric, dict) else {"name": metric}
    name = options.pop("name", None)
    if name is None or str(name).upper() not in METRICS:
        raise ValueError(f"Unknown metric {metric!r}. Available: {sorted(METRICS)}")
    return METRICS[str(name).upper()](**options)


def get_metrics(metrics: Sequence[str | dict | Metric], levels: Sequence[float] = ()) -> list[Metric]:
    found = [get_metric(m) for m in metrics]
    names = [m.name for m in found]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Give each metric once, not several times: {twice}")
    for m in found:
        if m.needs_quantiles and not levels:
            raise ValueError(f"{m.name} needs quantile_levels")
    return found


def evaluate(scored: DataFrame, metrics: Sequence[str | dict | Metric], levels: Sequence[float] = (), by: Sequence[str] = ("window_idx",), dim: str = "target_name", per_quantile: bool = False) -> DataFrame:
    """A row for each ``by`` with a column for each metric (and ``NAME[level]`` if asked)."""
    found = get_metrics(metrics, levels)
    each = {(i, j): c for i, m in enumerate(found) for j, c in enumerate(m.columns(levels))}
    per_dim = scored.groupBy(*by, dim).agg(*(c.alias(f"m{i}_{j}") for (i, j), c in each.items()))
    means = per_dim.groupBy(*by).agg(*(strict_avg(F.col(f"m{i}_{j}")).alias(f"m{i}_{j}") for i, j in each))
    out: list[Column] = []
    for i, m in enumerate(found):
        own = [F.col(f"m{a}_{b}") for a, b in each if a == i]
        total = own[0]
        for c in own[1:]:
            total = total + c
        out.append((total / len(own)).alias(m.name))
        if per_quantile and m.needs_quantiles:
            out += [c.alias(f"{m.name}[{level}]") for c, level in zip(own, levels)]
    return means.select(*by, *out)


def average_windows(scores: DataFrame, by: Sequence[str] = (), window: str = "window_idx") -> DataFrame:
    """Plain means over windows, however many items each has."""
    names = [c for c in scores.columns if c not in (*by, window)]
    return scores.groupBy(*by).agg(*(strict_avg(F.col(f"`{c}`")).alias(c) for c in names))


def scored_long(windows: DataFrame, forecasts: DataFrame, targets: Sequence[str], season: int, levels: Sequence[float] = (), id_column: str = "id", scales: DataFrame | None = None) -> DataFrame:
    """The metrics' input from windows and nested forecasts.

    ``scales``: window_idx, id, target_name, scale_abs, scale_sq where the windows do not hold
    the whole past (default: from the windows' own past).

    ``forecasts``: window_idx, id, target_name, predictions (array) and a column of
    arrays for each level, named by the level.  One equi-join on (window, id, target).
    """
    from ..functions.series import seasonal_error

    each = F.array(*(F.struct(F.lit(t).alias("target_name"), F.col("past").getField(t).cast("array<double>").alias("past"), F.col("future").getField(t).cast("array<double>").alias("truth")) for t in targets))
    truth = windows.select("window_idx", F.col(id_column).alias("id"), F.explode(each).alias("_t")).select("window_idx", "id", "_t.target_name", "_t.truth", seasonal_error("_t.past", season).alias(ABS), seasonal_error("_t.past", season, True).alias(SQ))
    if scales is not None:
        truth = truth.drop(ABS, SQ).join(scales, ["window_idx", "id", "target_name"])
    joined = truth.join(forecasts.withColumnRenamed(id_column, "id"), ["window_idx", "id", "target_name"])
    return to_steps(joined, levels)


def to_steps(joined: DataFrame, levels: Sequence[float] = (), keep: Sequence[str] = ()) -> DataFrame:
    """One row for each step from arrays ``truth``, ``predictions`` and the levels."""
    from ..functions.numeric import known

    arrays = [F.col("truth").alias("y"), F.col("predictions").alias("p"), *(F.col(f"`{level}`").alias(f"q_{i}") for i, level in enumerate(levels))]
    names = ["y", "p", *(f"q_{i}" for i in range(len(levels)))]
    out = joined.select(*keep, "window_idx", "id", "target_name", ABS, SQ, F.posexplode(F.arrays_zip(*arrays)).alias("step", "_v"))
    return out.select(*keep, "window_idx", "id", "target_name", "step", ABS, SQ, *(known(F.col("_v")[n]).alias(n) for n in names))

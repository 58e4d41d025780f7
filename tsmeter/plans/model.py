"""Models: a base class with a registry, baselines, and a runner."""

from __future__ import annotations

import inspect
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import autoregression, baselines, smoothing
from .benchmark import Benchmark
from .task import Task, Timer


class ForecastingModel(ABC):
    """A model gives keyed nested forecasts of all windows of a task.

    A concrete subclass is registered under ``model_name`` (default: its name in lower
    case without 'Model').
    """

    registry: ClassVar[dict[str, type[ForecastingModel]]] = {}
    model_name: str | None = None
    #: Names of datasets (configs) that the model was trained on.
    trained_on: ClassVar[Sequence[str]] = ()

    def __init_subclass__(cls, **options):
        super().__init_subclass__(**options)
        if inspect.isabstract(cls):
            return
        if "model_name" not in cls.__dict__ or cls.model_name is None:
            cls.model_name = cls.__name__.removesuffix("Model").lower()
        other = ForecastingModel.registry.setdefault(cls.model_name, cls)
        if other is not cls:
            raise ValueError(f"Model name {cls.model_name!r} is already registered by {other.__qualname__}")

    def __init__(self):
        self.training, self.inference = Timer(), Timer()

    def fit_predict(self, spark: SparkSession, task: Task) -> DataFrame:
        """window_idx, id, target_name, predictions and a column for each level; the
        timers start anew."""
        self.training, self.inference = Timer(), Timer()
        return self._fit_predict(spark, task)

    @abstractmethod
    def _fit_predict(self, spark: SparkSession, task: Task) -> DataFrame: ...

    @classmethod
    def available(cls) -> list[str]:
        return sorted(cls.registry)

    @classmethod
    def named(cls, name: str) -> type[ForecastingModel]:
        """By name, in any case."""
        if name.lower() not in cls.registry:
            raise ValueError(f"Unknown model {name!r}. Available: {cls.available()}")
        return cls.registry[name.lower()]


class BaselineModel(ForecastingModel):
    """A baseline written as expressions: forecasts come from the windows' own rows."""

    method = ""

    @abstractmethod
    def season(self, task: Task) -> int: ...

    def _fit_predict(self, spark, task):
        with self.inference:
            return baselines.forecast(task.windows(spark), self.method, task.targets, task.horizon, self.season(task), task.quantile_levels, task.id_column)


class NaiveModel(BaselineModel):
    method = "naive"

    def season(self, task):
        return 1


class SeasonalNaiveModel(BaselineModel):
    model_name = "seasonal_naive"
    method = "seasonal_naive"

    def season(self, task):
        return baselines.capped_season(task.seasonality, task.max_context_length)


class DriftModel(BaselineModel):
    method = "drift"

    def season(self, task):
        return 1


class AverageModel(BaselineModel):
    method = "average"

    def season(self, task):
        return 1


class SmoothingModel(ForecastingModel):
    """Series go through the method's recursion together, batch by batch."""

    method = ""

    @abstractmethod
    def options(self) -> dict: ...

    def _fit_predict(self, spark, task):
        season = baselines.capped_season(task.seasonality, task.max_context_length)
        with self.inference:
            return smoothing.forecast(task.windows(spark), self.method, task.targets, task.horizon, season, task.quantile_levels, task.id_column, **self.options())


class ThetaModel(SmoothingModel):
    method = "theta"

    def options(self):
        return {}


class EtsModel(SmoothingModel):
    method = "ets"

    def options(self):
        return {}


class CrostonModel(SmoothingModel):
    method = "croston"

    def options(self):
        return {"corrected": True}


class StatisticalEnsembleModel(ForecastingModel):
    """Step-wise medians of Theta, ETS and the seasonal naive forecast, which also fills what they leave."""

    model_name = "statistical_ensemble"

    def _fit_predict(self, spark, task):
        season = baselines.capped_season(task.seasonality, task.max_context_length)
        with self.inference:
            return smoothing.median_ensemble(task.windows(spark), ["theta", "ets"], task.targets, task.horizon, season, task.quantile_levels, task.id_column)


class AutoregressionModel(ForecastingModel):
    """One autoregression for all series of a target, tuned on what lies before the first cutoff."""

    def candidates(self, season: int) -> list[autoregression.Candidate]:
        lags = list(dict.fromkeys([(1,), (1, 2, 3), *([(season,), (1, season)] if season > 1 else [])]))
        return [autoregression.Candidate(t, own) for t in ("none", "difference") for own in lags]

    def _fit_predict(self, spark, task):
        windows, out = task.windows(spark), None
        first = windows.filter(F.col("window_idx") == 0)
        for target in task.targets:
            with self.training:
                history = first.select(F.col("past").getField(target).alias(target))
                tuned = autoregression.tune(history, target, self.candidates(task.seasonality), task.horizon, (2 * task.horizon, task.horizon))
            with self.inference:
                one = autoregression.forecast(windows, tuned, target, task.horizon, task.id_column)
            out = one if out is None else out.unionByName(one)
        # only points: they stand for every level; a past without the lags has the last known value
        last = baselines.forecast(windows, "naive", task.targets, task.horizon, 1, (), task.id_column).withColumnRenamed("predictions", "_last")
        filled = out.join(last.withColumn("id", F.col("id").cast("string")), ["window_idx", "id", "target_name"])
        points = F.zip_with("predictions", "_last", lambda a, b: F.coalesce(a, b))
        return filled.select("window_idx", "id", "target_name", points.alias("predictions"), *(points.alias(str(q)) for q in task.quantile_levels))


class PerSeriesModel(ForecastingModel):
    """A model of one series at a time in Python: subclasses write ``predict``.

    Series are grouped by (window, id, target) and forecast in Arrow batches; a group is
    one series.
    """

    @abstractmethod
    def predict(self, history: pd.Series, horizon: int, levels: Sequence[float]) -> dict[str, list[float]]:
        """``predictions`` and a list for each level (named by it)."""

    def _fit_predict(self, spark, task):
        horizon, levels, predict = task.horizon, list(task.quantile_levels), self.predict
        names = ["predictions", *map(str, levels)]
        each = F.array(*(F.struct(F.lit(t).alias("target_name"), F.col("past").getField(t).cast("array<double>").alias("y")) for t in task.targets))
        rows = task.windows(spark).select("window_idx", F.col(task.id_column).alias("id"), F.explode(each).alias("_t")).select("window_idx", "id", "_t.target_name", "_t.y")
        schema = T.StructType([T.StructField("window_idx", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("target_name", T.StringType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])

        def run(batches):
            for batch in batches:
                got = [predict(pd.Series(y, dtype=float), horizon, levels) for y in batch["y"]]
                out = batch[["window_idx", "id", "target_name"]].copy()
                for n in names:
                    out[n] = [[float(v) for v in g[n]] for g in got]
                yield out

        with self.inference:
            return rows.mapInPandas(run, schema)


def run(spark: SparkSession, model: ForecastingModel | str, tasks: Benchmark | Sequence[Task], storage_options: dict | None = None) -> list[dict]:
    """A summary row for each task; ``storage_options`` go to all reads of the tasks."""
    model = ForecastingModel.named(model)() if isinstance(model, str) else model
    out = []
    for task in tasks.tasks if isinstance(tasks, Benchmark) else tasks:
        forecasts = model.fit_predict(spark, task.stored_with(storage_options))
        with model.inference:
            forecasts = forecasts.persist()
            forecasts.count()
        out.append(task.evaluation_summary(spark, forecasts, model.model_name, model.training.seconds, model.inference.seconds, task.dataset_config in model.trained_on))
        forecasts.unpersist()
    return out

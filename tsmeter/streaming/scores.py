"""Scores of a stream of actual values against forecasts made before.

The stream keeps one row of sums for each (window, target), so its state does not grow
with the data; the sums give the scores at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import known, mean_ratio

SUMS = ("n", "sum_abs", "sum_err", "sum_sq", "sum_truth", "sum_scaled", "n_scaled")


def step_forecasts(nested: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested forecasts with timestamps as a row for each step."""
    return nested.select("window_idx", "id", "target_name", *keep, F.inline(F.arrays_zip(F.col("timestamp").alias("timestamp"), F.col("predictions").alias("p"))))


def error_sums(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """``actuals`` (stream or table): id, target_name, timestamp, y.  ``forecasts``
    (table): window_idx, id, target_name, timestamp, p, scale_abs."""
    y, p = known("y"), known("p")
    joined = actuals.join(forecasts, ["id", "target_name", "timestamp"])
    scaled = F.try_divide(F.abs(y - p), known("scale_abs"))
    return joined.groupBy("window_idx", "target_name").agg(
        F.count(y).alias("n"), F.sum(F.abs(y - p)).alias("sum_abs"), F.sum(p - y).alias("sum_err"), F.sum((y - p) * (y - p)).alias("sum_sq"), F.sum(F.abs(y)).alias("sum_truth"), F.sum(scaled).alias("sum_scaled"), F.count(scaled).alias("n_scaled"),
    )


def scores(sums: DataFrame) -> DataFrame:
    """MAE, MAEB, WAPE, MSE, RMSE and MASE of each (window, target) from its sums."""
    n = F.col("n")
    mean = lambda c: F.try_divide(F.col(c), n)
    return sums.select(
        "window_idx", "target_name", "n",
        mean("sum_abs").alias("MAE"), (mean("sum_abs") + F.abs(mean("sum_err"))).alias("MAEB"), mean_ratio(F.col("sum_abs"), F.col("sum_truth")).alias("WAPE"), mean("sum_sq").alias("MSE"), F.sqrt(mean("sum_sq")).alias("RMSE"), F.try_divide(F.col("sum_scaled"), F.col("n_scaled")).alias("MASE"),
    )


def actuals_from_events(events: DataFrame, id_column: str, timestamp_column: str, value: str, step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events summed to steps: windows close ``late`` after their end (append mode)."""
    w = F.window(timestamp_column, step)
    out = events.withWatermark(timestamp_column, late) if events.isStreaming else events
    return out.groupBy(F.col(id_column).alias("id"), w.alias("_w")).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n_events")).select("id", F.col("_w.start").cast("timestamp_ntz").alias("timestamp"), "y", "n_events")


def start(actuals: DataFrame, forecasts: DataFrame, name: str, checkpoint: str | None = None):
    """A running query whose memory table ``name`` holds the sums (complete mode)."""
    writer = error_sums(actuals, forecasts).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

"""Evaluation windows: every window of a task in one narrow plan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series


def split(
    df: DataFrame,
    cutoffs: Sequence[int] | Sequence[datetime],
    horizon: int,
    id_column: str = "id",
    timestamp_column: str = "timestamp",
    dynamic: Sequence[str] = ("target",),
    static: Sequence[str] = (),
    min_context: int = 1,
    max_context: int | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """window_idx, id, cut (past steps), static columns, past and future structs.

    A series is kept in a window if it has ``min_context`` steps before the cutoff and
    ``horizon`` after it; the past holds the last ``max_context`` steps.  Each array is
    sliced in its own row: no shuffle, one row for each window and kept series.
    """
    whole = all(isinstance(c, int) for c in cutoffs)
    windows = F.array(*(F.struct(F.lit(i).alias("window_idx"), (F.lit(c) if whole else F.lit(c).cast("timestamp_ntz")).alias("cutoff")) for i, c in enumerate(cutoffs)))
    arrays = [timestamp_column, *dynamic]
    each = df.select(id_column, *arrays, *static, *extra, F.explode(windows).alias("_w"))
    length = F.size(timestamp_column)
    cut = series.cutoff_index(length, F.col("_w.cutoff")) if whole else series.cutoff_index_at(F.col(timestamp_column), F.col("_w.cutoff"))
    kept = each.withColumn("cut", cut).filter((F.col("cut") >= min_context) & (length - F.col("cut") >= horizon))
    start = F.lit(0) if max_context is None else F.greatest(F.lit(0), F.col("cut") - max_context)
    past = F.struct(*(F.slice(F.col(f"`{c}`"), start + 1, F.col("cut") - start).alias(c) for c in arrays))
    future = F.struct(*(F.slice(F.col(f"`{c}`"), F.col("cut") + 1, F.lit(horizon)).alias(c) for c in arrays))
    return kept.select(F.col("_w.window_idx").alias("window_idx"), F.col("_w.cutoff").alias("cutoff"), id_column, "cut", *static, *extra, past.alias("past"), future.alias("future"))


def past(windows: DataFrame, columns: Sequence[str], id_column: str = "id", timestamp_column: str = "timestamp", static: Sequence[str] = ()) -> DataFrame:
    """What a model may see: history of all columns."""
    return windows.select("window_idx", id_column, F.col("past").getField(timestamp_column).alias(timestamp_column), *(F.col("past").getField(c).alias(c) for c in columns), *static)


def future(windows: DataFrame, known: Sequence[str] = (), id_column: str = "id", timestamp_column: str = "timestamp", static: Sequence[str] = ()) -> DataFrame:
    """What a model may know of the future: timestamps and known covariates."""
    return windows.select("window_idx", id_column, F.col("future").getField(timestamp_column).alias(timestamp_column), *(F.col("future").getField(c).alias(c) for c in known), *static)


def ground_truth(windows: DataFrame, targets: Sequence[str], id_column: str = "id", timestamp_column: str = "timestamp") -> DataFrame:
    return windows.select("window_idx", id_column, F.col("future").getField(timestamp_column).alias(timestamp_column), *(F.col("future").getField(c).alias(c) for c in targets))


def dropped(df: DataFrame, windows: DataFrame, n_windows: int) -> DataFrame:
    """window_idx, kept, dropped: how many series each window left out."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = windows.groupBy("window_idx").agg(F.count(F.lit(1)).alias("kept"))
    every = df.sparkSession.range(n_windows).select(F.col("id").cast("int").alias("window_idx"))
    return every.join(F.broadcast(total)).join(counts, "window_idx", "left").select("window_idx", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("dropped"))

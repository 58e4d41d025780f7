"""Theta, ETS and Croston forecasts of windows: a narrow pass over Arrow batches in which the
series of similar length go through numpy together (``functions.recursions``)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursions, series
from ..functions.numeric import known
from . import baselines, predictions

METHODS = {"theta": recursions.theta, "ets": recursions.ets, "croston": recursions.croston}
#: Numbers that are smoothed together.
CELLS = 1 << 20


def complete(history: Column) -> Column:
    """Missing values replaced by the last known one; leading ones left out."""
    filled = series.forward_fill(F.transform(history, lambda x: known(x)))
    return F.filter(filled, lambda x: x.isNotNull())


def forecast(windows: DataFrame, method: str, targets: Sequence[str], horizon: int, season: int = 1, levels: Sequence[float] = (), id_column: str = "id", target_name: str = "target_name", cells: int = CELLS, **options) -> DataFrame:
    """Nested forecasts in the form of ``baselines.forecast``.

    A history without a known value has null forecasts; missing values count as the last known one.
    Infinite values are not allowed for.  ``options`` go to the method.
    """
    method_ = METHODS[method]
    each = F.array(*(F.struct(F.lit(t).alias("name"), F.col("past").getField(t).cast("array<double>").alias("y")) for t in targets))
    rows = windows.select("window_idx", F.col(id_column).cast("string").alias("id"), F.explode(each).alias("_t")).select("window_idx", "id", F.col("_t.name").alias(target_name), complete(F.col("_t.y")).alias("y"))
    names = ["predictions", *map(str, levels)]
    schema = f"window_idx int, id string, {target_name} string, " + ", ".join(f"`{n}` array<double>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y")
            lengths = pc.list_value_length(y).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = y.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            out = np.full((len(names), batch.num_rows, horizon), np.nan)
            for part in recursions.length_batches(lengths, cells):
                part = part[lengths[part] > 0]
                if len(part):
                    for k, found in enumerate(method_(recursions.padded(values, starts[part], lengths[part]), lengths[part], horizon, season, levels, **options)):
                        out[k, part] = found
            offsets = pa.array(np.arange(batch.num_rows + 1) * horizon, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(out[k].reshape(-1), mask=np.isnan(out[k].reshape(-1)))) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("window_idx"), batch.column("id"), batch.column(target_name), *lists], names=["window_idx", "id", target_name, *names])

    return rows.mapInArrow(run, schema)


def median_ensemble(windows: DataFrame, methods: Sequence[str], targets: Sequence[str], horizon: int, season: int = 1, levels: Sequence[float] = (), id_column: str = "id") -> DataFrame:
    """The median of several methods' forecasts; where none of them has a value, the seasonal naive one."""
    keys = ["window_idx", "id", "target_name"]
    members = None
    for m in methods:
        one = forecast(windows, m, targets, horizon, season, levels, id_column)
        members = one if members is None else members.unionByName(one)
    together = predictions.ensemble(members, keys, levels)
    plain = baselines.forecast(windows, "seasonal_naive", targets, horizon, season, levels, id_column)
    names = ["predictions", *map(str, levels)]
    plain = plain.select(*keys, *(F.col(f"`{n}`").alias(f"plain {n}") for n in names))
    both = together.join(plain, keys, "right")
    return both.select(*keys, *(F.zip_with(F.coalesce(F.col(f"`{n}`"), F.col(f"`plain {n}`")), F.col(f"`plain {n}`"), lambda a, b: F.coalesce(a, b)).alias(n) for n in names))

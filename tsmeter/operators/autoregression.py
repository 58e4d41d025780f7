"""One linear autoregression for all series, its lags and transform chosen by rolling origins.

A candidate is a transform and a set of lags.  All candidates of a transform share the normal
equations of the union of lags, so one scan gives every candidate's fit at every origin:
tasks add up X'X and X'y in numpy, one small matrix for each transform and origin, and Spark
adds these.  A second scan forecasts all candidates from all origins and adds up their errors.
The driver holds (lags + 2)^2 numbers for each transform and origin, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recursions
from .smoothing import CELLS, complete

TRANSFORMS = ("none", "difference", "log")


@dataclass(frozen=True)
class Candidate:
    transform: str
    lags: tuple[int, ...]

    def __post_init__(self):
        if self.transform not in TRANSFORMS or not self.lags or min(self.lags) < 1 or len(set(self.lags)) != len(self.lags):
            raise ValueError(f"Not a candidate: {self.transform!r} of {TRANSFORMS} with lags {self.lags}")


@dataclass(frozen=True)
class Tuned:
    """The chosen candidate, its constant and weights (fitted before the last origin given), and
    the mean absolute error of each candidate from each origin."""

    candidate: Candidate
    weights: np.ndarray
    errors: dict[tuple[Candidate, int], float]


def _series(rows: DataFrame, target: str) -> DataFrame:
    return rows.select(complete(F.col(target)).alias("y"))


def _batches(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, right-aligned series (NaN before their starts) and lengths, of similar length."""
    for batch in batches:
        y = batch.column("y")
        lengths = pc.list_value_length(y).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = y.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for part in recursions.length_batches(lengths, cells):
            left = recursions.padded(values, starts[part], lengths[part])
            at = np.arange(left.shape[1]) - (left.shape[1] - lengths[part])[:, None]
            yield part, np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), axis=1), np.nan) if left.size else left, lengths[part]


def transformed(y: np.ndarray, transform: str) -> np.ndarray:
    if transform == "difference":
        return np.diff(y, axis=1, prepend=np.nan)
    return np.log1p(np.where(y > -1, y, np.nan)) if transform == "log" else y


def moments(rows: DataFrame, target: str, transforms: Sequence[str], lags: Sequence[int], origins: Sequence[int], cells: int = CELLS) -> dict[tuple[str, int], np.ndarray]:
    """Sums of products of (1, lagged values, value) over the steps before each origin (a number of
    steps before the end, 0 for the whole series) that have all of the lags."""
    lags, size = sorted(lags), len(lags) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(transforms), len(origins), size, size))
        for _, y, _ in _batches(batches, cells):
            width = y.shape[1]
            for i, transform in enumerate(transforms):
                z = transformed(y, transform)
                for j, origin in enumerate(origins):
                    end = width - origin
                    if end <= lags[-1]:
                        continue
                    columns = [np.ones_like(z[:, lags[-1] : end]), *(z[:, lags[-1] - lag : end - lag] for lag in lags), z[:, lags[-1] : end]]
                    x = np.stack([c.reshape(-1) for c in columns], axis=1)
                    x = x[np.isfinite(x).all(axis=1)]
                    total[i, j] += x.T @ x
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "value"])

    summed = _series(rows, target).mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(len(transforms) * len(origins) * size * size)
    for r in summed.collect():
        out[r["cell"]] = r["value"]
    out = out.reshape(len(transforms), len(origins), size, size)
    return {(t, o): out[i, j] for i, t in enumerate(transforms) for j, o in enumerate(origins)}


def solve(sums: np.ndarray, lags: Sequence[int], chosen: Sequence[int], ridge: float = 0.0) -> np.ndarray:
    """Constant and weights of the chosen lags by Cholesky (a least-norm solution where lags are
    collinear)."""
    at = [0, *(1 + sorted(lags).index(lag) for lag in chosen)]
    a, b = sums[np.ix_(at, at)] + ridge * np.diag([0.0, *[1.0] * len(chosen)]), sums[at, -1]
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        lower = np.linalg.cholesky(a * scale[:, None] * scale)
        return scale * np.linalg.solve(lower.T, np.linalg.solve(lower, b * scale))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def ahead(y: np.ndarray, candidate: Candidate, weights: np.ndarray, horizon: int) -> np.ndarray:
    """Recursive forecasts from the ends of right-aligned series (NaN where a lag is missing)."""
    need = max(candidate.lags) + 1
    y = np.concatenate((np.full((len(y), max(0, need - y.shape[1])), np.nan), y), axis=1)[:, -need:]
    z = transformed(y, candidate.transform)
    out = np.empty((len(y), horizon))
    for k in range(horizon):
        out[:, k] = weights[0] + sum(w * z[:, z.shape[1] - lag] for w, lag in zip(weights[1:], candidate.lags))
        z = np.concatenate((z[:, 1:], out[:, k : k + 1]), axis=1)
    if candidate.transform == "difference":
        return y[:, -1:] + np.cumsum(out, axis=1)
    return np.expm1(out) if candidate.transform == "log" else out


def tune(rows: DataFrame, target: str, candidates: Sequence[Candidate], horizon: int, origins: Sequence[int], ridge: float = 0.0, cells: int = CELLS) -> Tuned:
    """The candidate with the least mean absolute error over the origins (the first of equals).

    ``rows``: nested series.  Missing values count as the last known one, leading ones are left out.  A
    series is forecast from an origin if it has all lags of all candidates before it.
    """
    if not candidates or not origins or min(origins) < horizon:
        raise ValueError("Give candidates, and origins that leave the horizon")
    lags = sorted({lag for c in candidates for lag in c.lags})
    transforms = list(dict.fromkeys(c.transform for c in candidates))
    sums = moments(rows, target, transforms, lags, [*origins, 0], cells)
    fits = {(c, o): solve(sums[c.transform, o], lags, c.lags, ridge) for c in candidates for o in (*origins, 0)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(candidates), len(origins), 2))
        for _, y, n in _batches(batches, cells):
            for j, origin in enumerate(origins):
                own = y[n - origin >= lags[-1] + 1]
                if not len(own):
                    continue
                end = own.shape[1] - origin
                truth = own[:, end : end + horizon]
                for i, c in enumerate(candidates):
                    error = np.abs(truth - ahead(own[:, :end], c, fits[c, origin], horizon))
                    known = np.isfinite(error)
                    total[i, j] += error[known].sum(), known.sum()
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "value"])

    found = np.zeros(len(candidates) * len(origins) * 2)
    for r in _series(rows, target).mapInArrow(score, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        found[r["cell"]] = r["value"]
    found = found.reshape(len(candidates), len(origins), 2)
    errors = np.divide(found[..., 0], found[..., 1], out=np.full(found.shape[:2], np.inf), where=found[..., 1] > 0)
    best = candidates[int(errors.mean(axis=1).argmin())]
    return Tuned(best, fits[best, 0], {(c, o): float(errors[i, j]) for i, c in enumerate(candidates) for j, o in enumerate(origins)})


def forecast(windows: DataFrame, tuned: Tuned, target: str, horizon: int, id_column: str = "id", cells: int = CELLS) -> DataFrame:
    """Nested forecasts of windows in the form of ``baselines.forecast`` (null for a past without all lags)."""
    rows = windows.select("window_idx", F.col(id_column).cast("string").alias("id"), complete(F.col("past").getField(target)).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, horizon), np.nan)
            for part, y, _ in _batches(iter([batch]), cells):
                out[part] = ahead(y, tuned.candidate, tuned.weights, horizon)
            flat = out.reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * horizon, pa.int32()), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("window_idx"), batch.column("id"), pa.array([target] * batch.num_rows), lists], names=["window_idx", "id", "target_name", "predictions"])

    return rows.mapInArrow(run, "window_idx int, id string, target_name string, predictions array<double>")

"""Exponential smoothing of many series at once, in numpy.

All series of a batch go forward in time together: a step of the recursion is one operation
on a column of the batch.  Parameters are searched for all series in step as well, by
golden section (one parameter) or Nelder-Mead (several).  Series are left-aligned in a matrix
``y`` with their lengths ``n``; what lies beyond a series' end never counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

GOLDEN = (5**0.5 - 1) / 2


def length_batches(lengths: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Indices of series in batches of similar length: a batch has at most ``cells`` cells (a
    longer series is a batch of its own) and its shortest member at least 7/8 of its longest."""
    order = np.argsort(lengths, kind="stable")[::-1]
    shorter, at = -lengths[order], 0
    while at < len(order):
        longest = max(1, int(lengths[order[at]]))
        most = max(1, cells // longest)
        similar = int(np.searchsorted(shorter, -(longest * 7 // 8), side="right"))
        end = min(len(order), at + most, max(similar, at + 1))
        yield order[at:end]
        at = end


def padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The series ``values[start : start + length]`` as rows, zeros behind their ends."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    for row, (lo, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        out[row, :n] = values[lo : lo + n]
    return out


def golden_section(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The minimum of each series' function between ``low`` and ``high``."""
    low, high = low.copy(), high.copy()
    a, b = high - GOLDEN * (high - low), low + GOLDEN * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        left = fa < fb
        low, high = np.where(left, low, a), np.where(left, b, high)
        a, b, fa, fb = np.where(left, high - GOLDEN * (high - low), b), np.where(left, a, low + GOLDEN * (high - low)), np.where(left, np.nan, fb), np.where(left, fa, np.nan)
        new = f(np.where(left, a, b))
        fa, fb = np.where(left, new, fa), np.where(left, fb, new)
    return (low + high) / 2


def nelder_mead(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: float = 0.7, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """The best point found for each series (rows of ``start``) and its value."""
    n, d = start.shape
    points = np.repeat(start[:, None, :], d + 1, axis=1)
    points[:, np.arange(1, d + 1), np.arange(d)] += step
    values = np.stack([f(points[:, k]) for k in range(d + 1)], axis=1)
    rows = np.arange(n)
    for _ in range(rounds):
        order = np.argsort(values, axis=1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)
        center, worst = points[:, :-1].mean(axis=1), points[:, -1]
        mirrored = 2 * center - worst
        at_mirrored = f(mirrored)
        better, poor = at_mirrored < values[:, 0], at_mirrored >= values[:, -2]
        further = np.where(better[:, None], 3 * center - 2 * worst, np.where((at_mirrored < values[:, -1])[:, None], (center + mirrored) / 2, (center + worst) / 2))
        at_further = f(further)
        use = (better & (at_further < at_mirrored)) | (poor & (at_further < np.minimum(at_mirrored, values[:, -1])))
        new, at_new = np.where(use[:, None], further, mirrored), np.where(use, at_further, at_mirrored)
        stuck = poor & ~use
        points[rows, -1], values[rows, -1] = np.where(stuck[:, None], worst, new), np.where(stuck, values[:, -1], at_new)
        if stuck.any():  # towards the best point
            for k in range(1, d + 1):
                points[:, k] = np.where(stuck[:, None], (points[:, k] + points[:, 0]) / 2, points[:, k])
                values[:, k] = np.where(stuck, f(points[:, k]), values[:, k])
    best = values.argmin(axis=1)
    return points[rows, best], values[rows, best]


# -- simple smoothing, Theta and Croston --------------------------------------------------------


def smooth(y: np.ndarray, n: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last levels and sums of squared one-step errors; ``alpha``: (series,) or (series, k)."""
    shape = (slice(None),) + (None,) * (alpha.ndim - 1)
    level = np.broadcast_to(y[:, 0][shape], alpha.shape).copy() if y.shape[1] else np.zeros(alpha.shape)
    squares = np.zeros(alpha.shape)
    for t in range(1, y.shape[1]):
        error = np.where((t < n)[shape], y[:, t][shape] - level, 0.0)
        squares += error * error
        level += alpha * error
    return level, squares


def best_alpha(y: np.ndarray, n: np.ndarray, alphas: Sequence[float] | None = None) -> np.ndarray:
    """The smoothing weight with the least squared error: of ``alphas`` (the first of equals), or
    by golden section around the best of a coarse grid."""
    grid = np.asarray(alphas if alphas is not None else np.linspace(0.01, 0.99, 15))
    _, squares = smooth(y, n, np.broadcast_to(grid, (len(y), len(grid))).copy())
    best = squares.argmin(axis=1)
    if alphas is not None:
        return grid[best]
    low, high = np.concatenate(([1e-4], grid))[best], np.concatenate((grid, [0.9999]))[best + 1]
    return golden_section(lambda a: smooth(y, n, a)[1], low, high)


def slope(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the least-squares line through each series (0 for one step)."""
    t = np.arange(y.shape[1])
    inside = t < n[:, None]
    center = (n - 1) / 2
    d = np.where(inside, t - center[:, None], 0.0)
    spread = (d * d).sum(axis=1)
    return np.divide((d * y).sum(axis=1), spread, out=np.zeros(len(y)), where=spread > 0)


def seasonal_indices(y: np.ndarray, n: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """(series, season) factors or terms of a classical decomposition, and whether they are factors.

    Only where the autocorrelation at the season is significant (90 %) and there are more
    than two seasons; else terms of 0.  Factors where all values are positive.
    """
    rows, width = y.shape
    t = np.arange(width)
    inside = t < n[:, None]
    factors = np.where(inside, y, 1.0).min(axis=1, initial=np.inf) > 0
    mean = y.sum(axis=1) / np.maximum(n, 1)
    d = np.where(inside, y - mean[:, None], 0.0)
    spread = np.maximum((d * d).sum(axis=1), 1e-300)
    r = np.stack([(d[:, k:] * d[:, : width - k]).sum(axis=1) / spread for k in range(1, season + 1)], axis=1) if width > season else np.zeros((rows, season))
    limit = 1.645 * np.sqrt((1 + 2 * (r[:, :-1] ** 2).sum(axis=1)) / np.maximum(n, 1))
    seasonal = (n > 2 * season) & (np.abs(r[:, -1]) > limit) & (season > 1)
    out = np.where(factors[:, None], 1.0, 0.0) * np.ones((1, season))
    if not seasonal.any():
        return out, factors
    half = season // 2
    sums = np.concatenate((np.zeros((rows, 1)), np.cumsum(y, axis=1)), axis=1)
    trend = np.full(y.shape, np.nan)
    middle = np.arange(half, width - half)
    if season % 2:
        trend[:, middle] = (sums[:, middle + half + 1] - sums[:, middle - half]) / season
    else:
        trend[:, middle] = (sums[:, middle + half] - sums[:, middle - half + 1] + (y[:, middle - half] + y[:, middle + half]) / 2) / season
    usable = np.isfinite(trend) & (t < (n - half)[:, None])
    parts = np.where(factors[:, None], np.divide(y, trend, out=np.ones_like(y), where=usable & (trend != 0)), y - np.where(usable, trend, 0.0))
    found = np.stack([np.divide(np.where(usable[:, k::season], parts[:, k::season], 0.0).sum(axis=1), usable[:, k::season].sum(axis=1), out=np.ones(rows), where=usable[:, k::season].any(axis=1)) for k in range(season)], axis=1)
    center = found.mean(axis=1, keepdims=True)
    found = np.where(factors[:, None], np.divide(found, center, out=np.ones_like(found), where=center != 0), found - center)
    return np.where(seasonal[:, None], found, out), factors


def _levels(points: np.ndarray, deviation: np.ndarray, levels: Sequence[float]) -> list[np.ndarray]:
    return [points + deviation * NormalDist().inv_cdf(q) for q in levels]


def theta(y: np.ndarray, n: np.ndarray, horizon: int, season: int = 1, levels: Sequence[float] = (), alphas: Sequence[float] | None = None) -> list[np.ndarray]:
    """The Theta method: smoothing with half of the linear trend as drift, after seasonal
    adjustment.  Points and normal quantiles, each (series, horizon)."""
    if season > 1:
        index, factors = seasonal_indices(y, n, season)
        own = index[:, np.arange(y.shape[1]) % season]
        y = np.where(np.arange(y.shape[1]) < n[:, None], np.where(factors[:, None], y / np.where(own == 0, 1.0, own), y - own), 0.0)
    alpha = best_alpha(y, n, alphas)
    level, squares = smooth(y, n, alpha)
    step = np.arange(horizon)
    points = level[:, None] + slope(y, n)[:, None] / 2 * (step + ((1 - (1 - alpha) ** n) / alpha)[:, None])
    sigma = np.sqrt(squares / np.maximum(n - 1, 1))
    out = [points, *_levels(points, sigma[:, None] * np.sqrt(1 + step * alpha[:, None] ** 2), levels)]
    if season > 1:
        ahead = np.take_along_axis(index, (n[:, None] + step) % season, axis=1)
        out = [np.where(factors[:, None], x * ahead, x + ahead) for x in out]
    return out


def croston(y: np.ndarray, n: np.ndarray, horizon: int, season: int = 1, levels: Sequence[float] = (), alpha: float = 0.1, corrected: bool = False) -> list[np.ndarray]:
    """Croston's method for intermittent demand: smoothed size over smoothed interval of the
    non-zero steps (``corrected``: times 1 - alpha / 2).  A series of zeros gives zeros."""
    size, gap, since = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    for t in range(y.shape[1]):
        since += 1
        hit = (t < n) & (y[:, t] != 0)
        first = hit & (gap == 0)
        size = np.where(first, y[:, t], np.where(hit, size + alpha * (y[:, t] - size), size))
        gap = np.where(first, since, np.where(hit, gap + alpha * (since - gap), gap))
        since = np.where(hit, 0, since)
    rate = np.divide(size, gap, out=np.zeros(len(y)), where=gap > 0) * (1 - alpha / 2 if corrected else 1)
    return [np.repeat(rate[:, None], horizon, axis=1) for _ in range(1 + len(levels))]


# -- state-space smoothing ------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """Which parts an additive state-space model has."""

    trend: bool
    damped: bool
    seasonal: bool

    @property
    def size(self) -> int:
        return 1 + self.trend + self.damped + self.seasonal


SHAPES = (Shape(False, False, False), Shape(True, False, False), Shape(True, True, False), Shape(False, False, True), Shape(True, False, True), Shape(True, True, True))


def _weights(u: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """alpha, beta, gamma, phi from unbounded parameters: 0 < beta < alpha < 1, gamma < 1 - alpha."""
    s = 1 / (1 + np.exp(-np.clip(u, -12, 12)))
    alpha = s[:, 0]
    beta = alpha * s[:, 1] if shape.trend else np.zeros(len(u))
    phi = 0.8 + 0.18 * s[:, 2] if shape.damped else np.ones(len(u))
    gamma = (1 - alpha) * s[:, -1] if shape.seasonal else np.zeros(len(u))
    return alpha, beta, gamma, phi


def states(y: np.ndarray, n: np.ndarray, season: int, shape: Shape, weights: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last level, trend and seasonal terms, and the sum of squared one-step errors.

    The first season (one step without seasons) sets the start: its mean, the mean change to
    the second season, and its deviations.
    """
    alpha, beta, gamma, phi = weights
    m = season if shape.seasonal else 1
    rows = len(y)
    first = y[:, :m].mean(axis=1)
    trend = np.zeros(rows)
    if shape.trend and y.shape[1] > m:
        second = np.where(n >= 2 * m, y[:, m : 2 * m].mean(axis=1) if y.shape[1] >= 2 * m else first, np.where(n > m, y[:, m], first))
        trend = (second - first) / m
    level = first - (trend * (m + 1) / 2 if m > 1 else trend)
    terms = y[:, :m] - first[:, None] if shape.seasonal else np.zeros((rows, 1))
    terms, squares = terms.copy(), np.zeros(rows)
    for t in range(y.shape[1]):
        s = t % m
        base = level + phi * trend
        error = np.where(t < n, y[:, t] - base - terms[:, s], 0.0)
        squares += error * error
        live = t < n
        level = np.where(live, base + alpha * error, level)
        trend = np.where(live, phi * trend + beta * error, trend)
        terms[:, s] += gamma * error
    return level, trend, terms, squares


def ets(y: np.ndarray, n: np.ndarray, horizon: int, season: int = 1, levels: Sequence[float] = (), rounds: int = 80) -> list[np.ndarray]:
    """Additive exponential smoothing: of the models without and with trend, damping and season
    the one with the least AICc of each series.  Points and normal quantiles."""
    rows, step = len(y), np.arange(1, horizon + 1)
    best, points, deviation = np.full(rows, np.inf), np.zeros((rows, horizon)), np.zeros((rows, horizon))
    for shape in SHAPES:
        m = season if shape.seasonal else 1
        k = shape.size + 1 + shape.trend + (m if shape.seasonal else 0) + 1
        able = (n >= max(2 * m, 2)) & (n > k + 1)
        if (shape.seasonal and season < 2) or not able.any() and shape.size > 1:
            continue
        u, squares = nelder_mead(lambda u, s=shape: states(y, n, season, s, _weights(u, s))[3], np.tile(np.array([-0.5, -2.0, 0.5, -2.0])[: shape.size], (rows, 1)), rounds=rounds)
        weights = _weights(u, shape)
        level, trend, terms, squares = states(y, n, season, shape, weights)
        free = np.maximum(n - k - 1, 1)
        score = n * np.log(np.maximum(squares / np.maximum(n, 1), 1e-12)) + 2 * k + 2 * k * (k + 1) / free
        score = np.where(able | (shape.size == 1), score, np.inf)
        alpha, beta, gamma, phi = weights
        grown = np.cumsum(phi[:, None] ** step, axis=1)
        ahead = level[:, None] + grown * trend[:, None] + (np.take_along_axis(terms, (n[:, None] + step - 1) % m, axis=1) if shape.seasonal else 0.0)
        impact = alpha[:, None] + beta[:, None] * grown + gamma[:, None] * (step % m == 0 if shape.seasonal else 0)
        variance = squares / np.maximum(n - 1, 1)
        spread = np.sqrt(variance[:, None] * (1 + np.concatenate((np.zeros((rows, 1)), np.cumsum(impact**2, axis=1)[:, :-1]), axis=1)))
        take = score < best
        best = np.where(take, score, best)
        points, deviation = np.where(take[:, None], ahead, points), np.where(take[:, None], spread, deviation)
    return [points, *_levels(points, deviation, levels)]

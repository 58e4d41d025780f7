"""Lockstep recursions against plain ones, series by series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsmeter.functions import recursions as rec
from tsmeter.operators import smoothing, windows
from tsmeter.plans.model import ForecastingModel


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 2, 5, 9, 30, 47, 60, 60])
    rows = [10 + 0.3 * np.arange(n) + 4 * np.sin(2 * np.pi * np.arange(n) / 4) + rng.normal(size=n) for n in lengths]
    rows[-1] = rows[-1] - 20
    return [x.tolist() for x in rows], rec.padded(np.concatenate(rows), np.cumsum(lengths) - lengths, lengths), lengths


def plain_smooth(y, a):
    level, squares = y[0], 0.0
    for x in y[1:]:
        squares += (x - level) ** 2
        level += a * (x - level)
    return level, squares


def plain_states(y, season, shape, alpha, beta, gamma, phi):
    m = season if shape.seasonal else 1
    first = sum(y[:m]) / m if len(y) >= m else None
    trend = 0.0
    if shape.trend:
        trend = (sum(y[m : 2 * m]) / m - first) / m if len(y) >= 2 * m else (y[m] - first) / m if len(y) > m else 0.0
    level = first - (trend * (m + 1) / 2 if m > 1 else trend)
    terms = [x - first for x in y[:m]] if shape.seasonal else [0.0]
    squares = 0.0
    for t, x in enumerate(y):
        base = level + phi * trend
        e = x - base - terms[t % m]
        squares += e * e
        level, trend = base + alpha * e, phi * trend + beta * e
        terms[t % m] += gamma * e
    return level, trend, terms, squares


def test_recursions(batch):
    rows, y, n = batch
    level, squares = rec.smooth(y, n, np.full(len(n), 0.3))
    assert np.allclose(list(zip(level, squares)), [plain_smooth(x, 0.3) for x in rows])
    for shape in rec.SHAPES:
        long = n >= 8
        got = rec.states(y, n, 4, shape, tuple(np.full(len(n), v) for v in (0.4, 0.1, 0.2, 0.9 if shape.damped else 1.0)))
        want = [plain_states(x, 4, shape, 0.4, 0.1, 0.2, 0.9 if shape.damped else 1.0) if len(x) >= 8 else None for x in rows]
        for i in np.flatnonzero(long):
            assert np.allclose([got[0][i], got[1][i], got[3][i]], [want[i][0], want[i][1], want[i][3]]) and np.allclose(got[2][i], want[i][2])


def test_searches(batch):
    rows, y, n = batch
    found = rec.best_alpha(y, n)
    for i in np.flatnonzero(n > 2):
        best = min(plain_smooth(rows[i], a)[1] for a in np.linspace(0.0001, 0.9999, 2000))
        assert plain_smooth(rows[i], found[i])[1] <= best * 1.0001
    rng = np.random.default_rng(0)
    for shape in rec.SHAPES[:5]:
        u, value = rec.nelder_mead(lambda u, s=shape: rec.states(y, n, 4, s, rec._weights(u, s))[3], np.tile(np.array([-0.5, -2.0, 0.5, -2.0])[: shape.size], (len(n), 1)))
        tries = np.min([rec.states(y, n, 4, shape, rec._weights(np.tile(rng.normal(0, 3, shape.size), (len(n), 1)), shape))[3] for _ in range(400)], axis=0)
        assert (value[n >= 30] <= tries[n >= 30] * 1.05).all()


def test_series_do_not_touch_each_other(batch):
    rows, y, n = batch
    for f in (rec.theta, rec.ets, rec.croston):
        together = f(y, n, 6, 4, (0.1, 0.9))
        for i in range(len(n)):
            alone = f(np.array([rows[i]]), n[i : i + 1], 6, 4, (0.1, 0.9))
            assert np.allclose([x[i] for x in together], [x[0] for x in alone])


def test_theta_follows_trend_and_season():
    y = np.array([(100 + t) * (1.5 if t % 4 == 0 else 0.9) for t in range(80)], float)
    points, low, high = rec.theta(y[None], np.array([80]), 8, 4, (0.1, 0.9))
    truth = np.array([(100 + t) * (1.5 if t % 4 == 0 else 0.9) for t in range(80, 88)])
    assert np.abs(points[0] / truth - 1).max() < 0.05 and (low < points).all() and (points < high).all()


def test_seasonal_indices_by_hand(batch):
    rows, y, n = batch
    index, factors = rec.seasonal_indices(y, n, 4)
    x = np.array(rows[5])
    trend = [None, None, *((x[t - 2] / 2 + x[t - 1] + x[t] + x[t + 1] + x[t + 2] / 2) / 4 for t in range(2, len(x) - 2)), None, None]
    found = np.array([np.mean([x[t] / trend[t] for t in range(k, len(x), 4) if trend[t] is not None]) for k in range(4)])
    assert factors[5] and np.allclose(index[5], found / found.mean())
    assert not factors[-1] and abs(index[-1].sum()) < 1e-9 and (index[0] == 1).all()


def test_croston_by_hand():
    y = np.array([[0, 0, 4.0, 0, 6.0, 3.0, 0, 0], [0.0] * 8])
    size, gap = 4.0, 3.0
    for value, wait in ((6.0, 2), (3.0, 1)):
        size, gap = size + 0.1 * (value - size), gap + 0.1 * (wait - gap)
    got = rec.croston(y, np.array([8, 8]), 2)[0]
    assert np.allclose(got, [[size / gap] * 2, [0, 0]])
    assert np.allclose(rec.croston(y, np.array([8, 8]), 2, corrected=True)[0], got * 0.95)


def test_length_batches_pad_little():
    lengths = np.random.default_rng(1).lognormal(5, 1, 20_000).astype(int) + 1
    parts = list(rec.length_batches(lengths, 1 << 18))
    assert sorted(np.concatenate(parts).tolist()) == list(range(20_000))
    cells = sum(len(p) * lengths[p].max() for p in parts)
    assert cells <= 1.1 * lengths.sum() and max(len(p) * lengths[p].max() for p in parts) <= max(1 << 18, lengths.max())


def test_forecasts_of_windows(spark, small):
    rows = [("a", [None, 1.0, 2.0, None, 4.0, 5.0, 9.0, 9.0]), ("b", [None] * 8), ("c", [float("nan"), 3.0] + [2.0] * 6)]
    df = spark.createDataFrame(rows, "id string, target array<double>").withColumn("timestamp", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.timestamp_micros(k * F.lit(86_400_000_000)).cast("timestamp_ntz")))
    w = windows.split(df, (-2,), 2)
    got = {r["id"]: r for r in smoothing.forecast(w, "theta", ["target"], 2, 1, (0.5,), cells=4).collect()}
    assert got["b"]["predictions"] == [None, None]
    want = rec.theta(np.array([[1.0, 2.0, 2.0, 4.0, 5.0]]), np.array([5]), 2)[0][0]
    assert np.allclose(got["a"]["predictions"], want) and np.allclose(got["a"]["0.5"], want)
    both = {r["id"]: r["predictions"] for r in smoothing.median_ensemble(w, ["theta", "croston"], ["target"], 2).collect()}
    assert np.allclose(both["a"], (want + rec.croston(np.array([[1.0, 2.0, 2.0, 4.0, 5.0]]), np.array([5]), 2)[0][0]) / 2) and both["b"] == [None, None]
    assert {"theta", "ets", "croston", "statistical_ensemble"} <= set(ForecastingModel.available())
    assert smoothing.forecast(w.limit(0), "ets", ["target"], 2).count() == 0

"""Global autoregressions against plain least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsmeter.operators import autoregression as ar
from tsmeter.operators import windows

CANDIDATES = [ar.Candidate("none", (1,)), ar.Candidate("none", (1, 2, 7)), ar.Candidate("difference", (1, 7)), ar.Candidate("log", (7,)), ar.Candidate("none", (7, 1))]


@pytest.fixture(scope="module")
def histories():
    rng = np.random.default_rng(4)
    out = []
    for n in (5, 12, 30, 33, 60, 61):
        y = [20.0, 21.0]
        while len(y) < n:
            y.append(5 + 0.5 * y[-1] + 0.25 * (y[-7] if len(y) >= 7 else y[0]) + rng.normal())
        out.append(y[:n])
    return out


def plain(histories, c, lags, origin, horizon):
    """Fit before the origin, forecasts from it, by loops."""
    f = {"none": lambda y: y, "difference": lambda y: [float("nan")] + list(np.diff(y)), "log": lambda y: list(np.log1p(y))}[c.transform]
    x, t = [], []
    for y in histories:
        z = f(y)
        for k in range(max(lags), len(y) - origin):
            row = [z[k], *(z[k - lag] for lag in lags)]
            if np.isfinite(row).all():
                x.append([1.0, *(z[k - lag] for lag in c.lags)])
                t.append(z[k])
    w = np.linalg.lstsq(np.array(x), np.array(t), rcond=None)[0]
    errors = []
    for y in histories:
        past = list(y[: len(y) - origin]) if origin else list(y)
        if len(past) < max(lags) + 1:
            continue
        z = list(f(past))
        for k in range(horizon):
            z.append(w[0] + sum(b * z[len(z) - lag] for b, lag in zip(w[1:], c.lags)))
            past.append(past[-1] + z[-1] if c.transform == "difference" else np.expm1(z[-1]) if c.transform == "log" else z[-1])
        if origin:
            errors += [abs(a - b) for a, b in zip(past[len(y) - origin :], y[len(y) - origin :][:horizon])]
    return w, float(np.mean(errors)) if errors else None


def test_tuning_equals_brute_force(spark, histories):
    df = spark.createDataFrame([(str(i), y) for i, y in enumerate(histories)], "id string, target array<double>").repartition(3)
    lags = sorted({lag for c in CANDIDATES for lag in c.lags})
    for cells in (1 << 20, 40):
        got = ar.tune(df, "target", CANDIDATES, 4, (8, 4), cells=cells)
        want = {(c, o): plain(histories, c, lags, o, 4)[1] for c in CANDIDATES for o in (8, 4)}
        assert got.errors == pytest.approx(want)
        best = min(CANDIDATES, key=lambda c: (want[c, 8] + want[c, 4]))
        assert set(got.candidate.lags) == set(best.lags) and got.candidate.transform == best.transform
        assert np.allclose(got.weights, plain(histories, got.candidate, lags, 0, 4)[0])


def test_forecasts_and_odd_tables(spark, histories):
    rows = [(str(i), y) for i, y in enumerate(histories)] + [("null", None), ("empty", []), ("gaps", [None, 20.0, None, *[21.0] * 12])]
    df = spark.createDataFrame(rows, "id string, target array<double>")
    tuned = ar.tune(df, "target", CANDIDATES[:2], 2, (4,))
    stamped = df.filter("target is not null").withColumn("timestamp", F.transform("target", lambda x, i: F.timestamp_micros(i.cast("long") * 86_400_000_000).cast("timestamp_ntz")))
    got = {r["id"]: r["predictions"] for r in ar.forecast(windows.split(stamped, (-3,), 3), tuned, "target", 3).collect()}
    c, w = tuned.candidate, tuned.weights
    y = list(histories[4][:-3])
    for _ in range(3):
        y.append(w[0] + sum(b * y[len(y) - lag] for b, lag in zip(w[1:], c.lags)))
    assert np.allclose(got["4"], y[-3:]) and (got["0"] == [None] * 3 or max(c.lags) == 1)
    assert ar.tune(df.limit(0), "target", CANDIDATES[:1], 2, (4,)).errors[CANDIDATES[0], 4] == float("inf")
    with pytest.raises(ValueError):
        ar.tune(df, "target", CANDIDATES, 5, (4,))
    with pytest.raises(ValueError):
        ar.Candidate("none", (0,))

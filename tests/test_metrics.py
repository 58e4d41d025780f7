"""The metrics against plain NumPy, with missing, infinite and zero values."""

import warnings

import numpy as np
import pytest

from tsmeter.operators import metrics

LEVELS = [0.1, 0.5, 0.9]
INF = float("inf")


def nanmean(x):
    x = x[~np.isnan(x)]
    return np.nan if not len(x) else x.mean()


def safemean(x):
    return nanmean(np.where(np.isfinite(x), x, np.nan))


def ratio(a, b):
    return a / b if not (np.isnan(a) or np.isnan(b)) else np.nan


def reference(name, y, p, q, scale, square, eps):
    """One target's score; y and p are items x steps, q has levels last."""
    a, s2 = (np.where(np.isnan(v), np.nan, np.maximum(v, eps))[:, None] for v in (scale, square))
    size = np.maximum(nanmean(np.abs(y)), eps)
    e, b = np.abs(y - p), np.abs(nanmean(p - y))
    loss = lambda i: 2 * np.abs((y - q[..., i]) * ((y <= q[..., i]) - LEVELS[i]))
    over = lambda f: np.mean([f(loss(i)) for i in range(3)])
    return {
        "MAE": lambda: nanmean(e), "MAEB": lambda: nanmean(e) + b, "WAPE": lambda: ratio(nanmean(e), size), "WAPEB": lambda: ratio(nanmean(e) + b, size), "MASE": lambda: safemean(e / a), "MSE": lambda: nanmean(e**2), "RMSE": lambda: np.sqrt(nanmean(e**2)), "RMSSE": lambda: np.sqrt(safemean(e**2 / s2)),
        "RMSLE": lambda: np.sqrt(nanmean((np.log1p(y) - np.log1p(p)) ** 2)), "MAPE": lambda: safemean(e / np.abs(y)), "SMAPE": lambda: safemean(2 * e / (np.abs(y) + np.abs(p))), "MQL": lambda: over(nanmean), "SQL": lambda: over(lambda x: safemean(x / a)), "WQL": lambda: over(lambda x: ratio(nanmean(x), size)),
    }[name]()


def case(kind, rng):
    y, p = rng.normal(5, 3, (4, 6)), rng.normal(5, 3, (4, 6))
    scale, square = rng.uniform(0.5, 2, 4), rng.uniform(0.5, 4, 4)
    if kind == "missing":
        y[rng.random(y.shape) < 0.3] = np.nan
    elif kind == "zero truth":
        y[:] = 0
    elif kind == "zero truth and forecast":
        y[:], p[:] = 0, 0
    elif kind == "zero scale":
        scale[1] = square[1] = 0
    elif kind == "no scale":
        scale[2] = square[2] = np.nan
    elif kind == "all missing":
        y[:] = np.nan
    elif kind == "minus one":
        y[0, 0], y[1, 1] = -1, -3
    elif kind == "both zero at a step":
        y[0, 0] = p[0, 0] = 0
    return y, p, p[..., None] + np.array([-1.0, 0.0, 1.0]), scale, square


KINDS = ["plain", "missing", "zero truth", "zero truth and forecast", "zero scale", "no scale", "all missing", "minus one", "both zero at a step"]


@pytest.mark.parametrize("eps", [0.0, 0.7])
def test_against_numpy(spark, eps):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    names = list(metrics.METRICS)
    for w, kind in enumerate(KINDS):
        for t, target in enumerate(("a", "b")):  # the second target is always plain
            y, p, q, scale, square = case(kind if t == 0 else "plain", rng)
            with warnings.catch_warnings(), np.errstate(all="ignore"):
                warnings.simplefilter("ignore")
                for n in names:
                    want[(w, target, n)] = float(reference(n, y, p, q, scale, square, eps if metrics.METRICS[n].takes_epsilon else 0.0))
            none = lambda v: None if np.isnan(v) else float(v)
            rows += [(w, target, str(i), s, none(scale[i]), none(square[i]), none(y[i, s]), float(p[i, s]), *map(float, q[i, s])) for i in range(4) for s in range(6)]
    df = spark.createDataFrame(rows, "window_idx int, target_name string, id string, step int, scale_abs double, scale_sq double, y double, p double, q_0 double, q_1 double, q_2 double")
    asked = [{"name": n, "epsilon": eps} if metrics.METRICS[n].takes_epsilon else n for n in names]
    got = {r.window_idx: r for r in metrics.evaluate(df, asked, LEVELS).collect()}
    single = {(r.window_idx, r.target_name): r for r in metrics.evaluate(df, asked, LEVELS, by=["window_idx", "target_name"], dim="id").collect()}
    assert len(single) == 2 * len(KINDS)
    for w, kind in enumerate(KINDS):
        for n in names:
            expected = np.mean([want[(w, t, n)] for t in "ab"])
            value = got[w][n]
            if np.isnan(expected):
                assert value is None or np.isnan(value), (kind, n, value)
            else:
                assert value == pytest.approx(expected, rel=1e-9), (kind, n)


def test_levels_and_windows(spark):
    rng = np.random.default_rng(4)
    y, p, q, scale, square = case("plain", rng)
    rows = [(w, "a", str(i), s, float(scale[i]), float(square[i]), float(y[i, s]) if w < 2 else None, float(p[i, s]), *map(float, q[i, s])) for w in range(3) for i in range(4) for s in range(6)]
    df = spark.createDataFrame(rows, "window_idx int, target_name string, id string, step int, scale_abs double, scale_sq double, y double, p double, q_0 double, q_1 double, q_2 double")
    out = metrics.evaluate(df, ["MAE", "sql"], LEVELS, per_quantile=True)
    assert out.columns == ["window_idx", "MAE", "SQL", "SQL[0.1]", "SQL[0.5]", "SQL[0.9]"]
    r = out.filter("window_idx = 0").first()
    assert r["SQL"] == pytest.approx(np.mean([r[f"SQL[{x}]"] for x in LEVELS]))
    assert metrics.evaluate(df, ["MASE", "SQL"], LEVELS).columns == ["window_idx", "MASE", "SQL"]
    half = metrics.evaluate(df, ["MQL", "MAE"], [0.5]).filter("window_idx = 0").first()
    assert half["MQL"] == pytest.approx(nanmean(np.abs(y - q[..., 0])))  # level 0.5 of the first column
    assert metrics.average_windows(out).first()["MAE"] is None  # one window has no truth
    assert metrics.average_windows(out.filter("window_idx < 2")).first()["MAE"] == pytest.approx(np.abs(y - p).mean())


def test_registry():
    assert metrics.get_metric("mase").name == "MASE" and metrics.get_metric({"name": "WQL", "epsilon": 1}).epsilon == 1
    for bad in ("nope", {"epsilon": 1}):
        with pytest.raises(ValueError, match="Unknown metric"):
            metrics.get_metric(bad)
    with pytest.raises(ValueError, match="no epsilon"):
        metrics.get_metric({"name": "MAE", "epsilon": 1})
    with pytest.raises(ValueError, match="each metric once"):
        metrics.get_metrics(["MASE", {"name": "mase", "epsilon": 1}])
    with pytest.raises(ValueError, match="quantile_levels"):
        metrics.get_metrics(["WQL"])

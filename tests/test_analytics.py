"""Comparisons of models: golden values and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsmeter.operators import analytics
from tsmeter.sources import summaries

#: MASE of three models on three tasks (fixed values, published results).
EXAMPLE = {"m1_quarterly": (2.0775365248114586, 1.6608102596243457, 1.705247), "electricity_weekly": (2.535526, 2.552429, 2.557008), "m1_yearly": (4.894322, 3.957011, 4.225722)}


@pytest.fixture()
def mock(spark):
    rows = [{"dataset_path": d, "model_name": m, "test_error": e, "training_time_s": t, "inference_time_s": i, "num_forecasts": n, "trained_on_this_dataset": False, "engine_version": "1.0.0"} for d, m, e, t, i, n in (("d1", "model_a", 1.0, 10.0, 5.0, 100), ("d1", "model_b", 2.0, 20.0, 10.0, 100), ("d2", "model_a", 1.5, 30.0, 15.0, 200), ("d2", "model_b", 3.0, 40.0, 20.0, 200))]
    with pytest.warns(UserWarning, match="missing from summaries"):
        return summaries.load(spark, rows).persist()


def board(df, **o):
    return {r.model_name: r.asDict() for r in analytics.leaderboard(df, **({"baseline_model": "model_b"} | o)).collect()}


@pytest.mark.parametrize("per", [None, 100, 1000])
def test_runtimes(mock, per):
    a = board(mock, normalize_time_per_n_forecasts=per)["model_a"]
    names = [f"median_{x}_time_s" + (f"_per{per}" if per else "") for x in ("training", "inference", "e2e")]
    assert [a[n] for n in names] == pytest.approx([20, 10, 30] if per is None else [0.125 * per, 0.0625 * per, 0.1875 * per])
    assert (a["skill_score"], a["win_rate"], a["num_failures"]) == (pytest.approx(0.5), 1.0, 0)


def test_num_forecasts(mock):
    part = mock.withColumn("num_forecasts", F.when(F.col("model_name") == "model_a", F.col("num_forecasts")))
    got = board(part.filter("dataset_path = 'd1'"), normalize_time_per_n_forecasts=100)
    assert (got["model_a"]["median_training_time_s_per100"], got["model_b"]["median_e2e_time_s_per100"]) == (10, 30)
    for bad in (F.when(F.col("model_name") == "model_b", 200).otherwise(F.col("num_forecasts")), F.lit(None).cast("bigint")):
        with pytest.raises(ValueError, match="inconsistent"):
            board(mock.withColumn("num_forecasts", bad), normalize_time_per_n_forecasts=100)


def example(spark):
    rows = [{"dataset_config": t, "model_name": m, "test_error": e, "engine_version": "1.0.0", "training_time_s": 0.0, "inference_time_s": 1.0} for t, values in EXAMPLE.items() for m, e in zip(("seasonal_naive", "ets", "theta"), values)]
    return summaries.load(spark, rows)


@pytest.mark.filterwarnings("ignore:Columns")
def test_published_example(spark):
    got = analytics.leaderboard(example(spark)).collect()
    assert [r.model_name for r in got] == ["ets", "seasonal_naive", "theta"]  # ties by name
    assert [(r.win_rate, r.skill_score) for r in got] == [pytest.approx(x, abs=2e-6) for x in ((0.833333, 0.133483), (0.333333, 0.0), (0.333333, 0.105932))]


@pytest.mark.filterwarnings("ignore:Columns")
def test_intervals_equal_a_plain_bootstrap(spark):
    rng = np.random.default_rng(0)
    e = np.exp(rng.normal(0, 0.4, (9, 3)))
    e[4, 1] = e[4, 0]
    names = ["seasonal_naive", "b", "c"]
    rows = [{"dataset_config": f"t{i}", "horizon": [None, 3, 1][i % 3], "model_name": m, "test_error": float(e[i, j]), "engine_version": "1.0.0"} for i in range(9) for j, m in enumerate(names)]
    df = summaries.load(spark, rows).persist()
    order = sorted(range(9), key=lambda i: f"t{i}")
    rel = (e / e[:, :1])[order]
    index = np.random.default_rng(123).integers(0, 9, (200, 9))

    def win(x):
        w = (x[:, :, None] < x[:, None, :]).mean(0) + 0.5 * (x[:, :, None] == x[:, None, :]).mean(0)
        np.fill_diagonal(w, np.nan)
        return np.nanmean(w, 1)

    wins = np.quantile([win(rel[k]) for k in index], [0.025, 0.975], axis=0)
    skills = np.quantile([1 - np.exp(np.log(rel[k]).mean(0)) for k in index], [0.025, 0.975], axis=0)
    got = {r.model_name: r for r in analytics.leaderboard(df, n_resamples=200).collect()}
    for j, m in enumerate(names):
        r = got[m]
        assert [r.win_rate_lower, r.win_rate_upper] == pytest.approx(wins[:, j]) and [r.skill_score_lower, r.skill_score_upper] == pytest.approx(skills[:, j], abs=1e-12)
    pairs = {(r.model_1, r.model_2): r for r in analytics.pairwise_comparison(df, n_resamples=200).collect()}
    ratio = np.clip(e[:, 1] / e[:, 2], 0.01, 100)[order]
    bounds = np.quantile([1 - np.exp(np.log(ratio[k]).mean()) for k in index], [0.025, 0.975])
    r = pairs[("b", "c")]
    assert len(pairs) == 9 and [r.skill_score_lower, r.skill_score_upper] == pytest.approx(bounds) and pairs[("b", "b")].win_rate == 0.5


@pytest.mark.filterwarnings("ignore:Columns")
def test_missing_and_leaked_results(spark):
    e = {"t1": {"seasonal_naive": 2.0, "a": 1.0, "b": None}, "t2": {"seasonal_naive": 4.0, "a": 1.0, "b": 8.0}, "t3": {"seasonal_naive": 1.0, "a": 1e-9, "b": 1.0}}
    rows = [{"dataset_config": t, "model_name": m, "test_error": v, "engine_version": "1.0.0", "trained_on_this_dataset": (t, m) == ("t2", "a")} for t, by in e.items() for m, v in by.items()]
    df = summaries.load(spark, rows).persist()
    with pytest.raises(ValueError, match="no result of these models.*'b': 1"):
        analytics.leaderboard(df)
    filled = {r.model_name: r for r in analytics.leaderboard(df, missing_strategy="impute").collect()}
    assert filled["b"].num_failures == 1 and filled["b"].skill_score == pytest.approx(1 - 2 ** (1 / 3)) and filled["a"].skill_score == pytest.approx(1 - (0.5 * 0.25 * 0.01) ** (1 / 3))
    assert filled["a"].training_corpus_overlap == pytest.approx(1 / 3)
    dropped = {r.model_name: r for r in analytics.leaderboard(df, missing_strategy="drop").collect()}
    assert dropped["a"].skill_score == pytest.approx(1 - (0.25 * 0.01) ** 0.5)
    leak = {r.model_name: r for r in analytics.leaderboard(df, missing_strategy="drop", leakage_imputation_model="seasonal_naive").collect()}
    assert leak["a"].skill_score == pytest.approx(1 - 0.01**0.5)
    for options, message in (({"leakage_imputation_model": "a"}, "must not be trained"), ({"leakage_imputation_model": "x"}, "is missing"), ({"baseline_model": "x"}, "is missing"), ({"baseline_model": "b"}, "missing for 1 tasks"), ({"missing_strategy": "x"}, "Invalid"), ({"included_models": ["a"], "excluded_models": ["b"]}, "not both")):
        with pytest.raises(ValueError, match=message):
            analytics.leaderboard(df, **({"missing_strategy": "impute"} | options)).collect()
    pair = {(r.model_1, r.model_2): r for r in analytics.pairwise_comparison(df, missing_strategy="impute", baseline_model="seasonal_naive").collect()}
    assert pair[("b", "seasonal_naive")].win_rate == pytest.approx((0.5 + 0 + 0.5) / 3)
    with pytest.raises(ValueError, match="Name the baseline_model"):
        analytics.pairwise_comparison(df, missing_strategy="impute")
    with pytest.raises(ValueError, match="Duplicate"):
        analytics.pivot_table(df.union(df))
    with pytest.raises(ValueError, match="without results"):
        analytics.filter_tasks(df.withColumn("task_name", F.col("dataset_config")), ["t1", "t9"])


def test_zero_errors_make_the_mean_zero(spark):
    df = spark.createDataFrame([("t1", "a", 0.0), ("t2", "a", 4.0), ("t1", "b", 1.0), ("t2", "b", 4.0), ("t1", "c", None)], "task string, model_name string, score double")
    got = {r.model_name: r.skill_score for r in analytics.skill_scores(df).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(-1.0), "c": None}
    assert {r.model_name: r.mean_rank for r in analytics.mean_ranks(df).collect()} == {"a": 1.25, "b": 1.75}
    assert analytics.win_rates(df.filter("model_name = 'a'")).first().win_rate is None


def test_summary_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("model_name,dataset_config,horizon,quantile_levels,test_error,target_column,tool_version,extra\nm,c,8,\"[0.1, 0.00010000001, 1.0]\",1.5,\"['x', 'y']\",0.6.1,z\n")
    (tmp_path / "b.json").write_text('[{"model_name": "n", "dataset_config": "c", "horizon": 8, "test_error": 2.5, "engine_version": "1.0.0", "trained_on_this_dataset": true}]')
    with pytest.warns(UserWarning, match="missing"):
        df = summaries.load(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")])
    got = {r.model_name: r for r in df.collect()}
    assert got["m"].quantile_levels == str([0.1, 0.0001, 1.0]) and got["n"].quantile_levels == "[]" and got["m"].target == "['x', 'y']" and got["m"].extra == "z" and got["n"].extra is None and got["m"].horizon == 8 and got["n"].trained_on_this_dataset is True
    with pytest.warns(UserWarning, match="before"):
        analytics.check_versions(df.withColumn("engine_version", F.lit("0.5.9")))
    with pytest.raises(ValueError, match="Unable to parse"):
        analytics.check_versions(df.withColumn("engine_version", F.lit("abc")))
    for bad in ("x.txt", 5):
        with pytest.raises(ValueError):
            summaries.load(spark, bad)
    with pytest.raises(ValueError, match="Both"):
        summaries.load(spark, df.withColumn("target_column", F.lit(1)))
    assert summaries.add_constant(df, "commit", "abc").filter("commit = 'abc'").count() == 2
    with pytest.raises(ValueError, match="already"):
        summaries.add_constant(df.withColumn("commit", F.lit("x")), "commit", "abc")


def test_submissions(spark):
    df = spark.createDataFrame([("m", "t1", 1.0), ("m", "t1", 1.0), ("m", "t2", None), ("n", "zzz", 1.0)], "model_name string, task_name string, MASE double")
    got = {(r.model_name, r.problem): r.n for r in analytics.submission_problems(df, ["t1", "t2"], ["MASE", "commit"], ["MASE"]).collect()}
    assert got == {("*", "missing column commit"): 1, ("m", "duplicate tasks"): 1, ("m", "undefined metrics"): 1, ("n", "unknown tasks"): 1}


def test_paths_lists_and_any_statistic(spark, tmp_path):
    rows = [{"dataset_config": t, "model_name": m, "test_error": e, "engine_version": "1.0.0", "training_time_s": 0.0, "inference_time_s": 1.0} for t, values in EXAMPLE.items() for m, e in zip(("seasonal_naive", "ets", "theta"), values)]
    (tmp_path / "all.json").write_text(__import__("json").dumps(rows))
    with pytest.warns(UserWarning, match="missing"):
        by_path = analytics.leaderboard(str(tmp_path / "all.json"), missing_strategy="impute").collect()
        by_list = analytics.leaderboard(rows, missing_strategy="impute").collect()
    assert [r.model_name for r in by_path] == [r.model_name for r in by_list] and len(by_path) == 3
    values = spark.createDataFrame([(m, i, float(i * (m == "a") + 1)) for m in "ab" for i in range(8)], "model_name string, task_ord int, score double")
    got = {r.model_name: (r.lower, r.upper) for r in analytics.bootstrap(values, ["model_name"], "score", lambda x: np.median(x, axis=1), 200, 5, 0.1).collect()}
    drawn = np.arange(1.0, 9.0)[np.random.default_rng(5).integers(0, 8, size=(200, 8))]
    assert got["b"] == (1.0, 1.0) and got["a"] == pytest.approx(tuple(np.quantile(np.median(drawn, axis=1), [0.05, 0.95])))


def test_intervals_of_many_tasks(spark, monkeypatch):
    """Blocks of draws are numpy's draws, whatever their size; nothing of resamples x tasks is kept."""
    rng = np.random.default_rng(2)
    v = {"a": rng.lognormal(size=700), "b": rng.lognormal(size=700), "zero": np.where(np.arange(700) == 5, 0.0, 2.0), "gap": np.where(np.arange(700) == 9, np.nan, 1.0)}
    df = spark.createDataFrame([(m, k, None if np.isnan(x) else float(x)) for m, xs in v.items() for k, x in enumerate(xs)], "model_name string, task_ord long, score double")
    draws = np.random.default_rng(7).integers(0, 700, size=(50, 700))
    for cells in (1 << 22, 2000, 10):
        monkeypatch.setattr(analytics, "CELLS", cells)
        assert analytics.resamples(700, 50, 7) == [np.bincount(d, minlength=700).tolist() for d in draws]
        for geometric in (False, True):
            got = {r.model_name: (r.lower, r.upper) for r in analytics.intervals(df, ["model_name"], "score", 50, 7, 0.1, geometric).collect()}
            for m in ("a", "b"):
                stat = 1 - np.exp(np.log(v[m][draws]).mean(axis=1)) if geometric else v[m][draws].mean(axis=1)
                assert got[m] == pytest.approx(np.quantile(stat, [0.05, 0.95]))
            assert got["gap"] == (None, None) and (not geometric or got["zero"][1] == 1.0)

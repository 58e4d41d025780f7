"""Tasks, predictions, models, benchmarks, sources."""

import datetime as dt
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsmeter.operators import adapters, predictions, windows
from tsmeter.plans.benchmark import Benchmark
from tsmeter.plans.model import ForecastingModel, PerSeriesModel, run
from tsmeter.plans.task import Task
from tsmeter.sources import datasets

from .test_windows import SCHEMA, day, long_rows


@pytest.mark.parametrize(
    "options",
    [{"num_windows": -1}, {"num_windows": 2, "initial_cutoff": -47}, {"num_windows": 2, "initial_cutoff": -48, "window_step_size": "24h"}, {"num_windows": 2, "initial_cutoff": "2021-01-01", "window_step_size": "-24h"}, {"num_windows": 2, "window_step_size": "24h"}, {"num_windows": 2, "window_step_size": 0}, {"seasonality": 0}, {"min_context_length": 0}, {"max_context_length": 0}, {"quantile_levels": [1.0]}, {"eval_metric": "WQL"}, {"extra_metrics": ["MASE"]}, {"target": []}, {"target": ["a"], "generate_univariate_targets_from": ["b"]}, {"surprise": 1}],
)
def test_invalid_tasks(options):
    with pytest.raises(ValueError):
        Task.of(dataset_path="d", horizon=24, **options)


@pytest.mark.parametrize(
    "options, cutoffs",
    [({"num_windows": 3}, [-36, -24, -12]), ({"num_windows": 3, "initial_cutoff": -48}, [-48, -36, -24]), ({"num_windows": 3, "initial_cutoff": -48, "window_step_size": 4}, [-48, -44, -40]), ({"num_windows": 2, "window_step_size": 4}, [-16, -12]), ({"num_windows": 2, "initial_cutoff": "2024-06-01", "window_step_size": "4h"}, ["2024-06-01T00:00:00", "2024-06-01T04:00:00"]), ({"num_windows": 2, "initial_cutoff": "2024-06-01", "window_step_size": "1ME"}, ["2024-06-01T00:00:00", "2024-06-30T00:00:00"])],
)
def test_cutoffs(options, cutoffs):
    got = Task.of(dataset_path="d", horizon=12, **options).cutoffs()
    assert [c if isinstance(c, int) else c.isoformat() for c in got] == cutoffs


def test_names_and_former_names():
    t = Task.of(dataset_path="/x/foo/bar/data.parquet", target=["b", "a"], known_dynamic_columns=["z", "y"], quantile_levels=[0.9, 0.1])
    assert (t.task_name, t.target, t.known_dynamic_columns, t.quantile_levels) == ("foo/bar", ["a", "b"], ["y", "z"], [0.1, 0.9])
    with pytest.warns(FutureWarning):
        assert Task.of(dataset_path="d", dataset_config="c", num_rolling_windows=2).num_windows == 2
    with pytest.raises(ValueError, match="new name"):
        Task.of(dataset_path="d", cutoff=-3, initial_cutoff=-3)
    assert t.predictions_schema.names == ["predictions", "0.1", "0.9"]


def test_long_file(spark, tmp_path):
    path = str(tmp_path / "long.parquet")
    spark.createDataFrame(long_rows(3, 20), SCHEMA).write.parquet(path)
    t = Task(path, horizon=4, id_column="item_id", static_columns=["category"])
    past, future = t.window(0).input_data(spark)
    assert [len(r.target) for r in past.collect()] == [16] * 3 and [len(r.timestamp) for r in future.collect()] == [4] * 3
    assert t.frequency() == "D" and future.columns == ["window_idx", "item_id", "timestamp", "category"]
    with pytest.raises(ValueError, match="index"):
        t.window(-1)
    with pytest.raises(ValueError, match="too short"):
        Task(path, horizon=30, id_column="item_id").window(0).input_data(spark)
    with pytest.raises(ValueError, match="Missing dynamic"):
        Task(path, horizon=4, id_column="item_id", known_dynamic_columns=["nope"]).load(spark)
    stepped = Task(path, horizon=4, id_column="item_id", initial_cutoff="2020-01-10", window_step_size=2, num_windows=2)
    assert stepped.cutoffs(spark) == [dt.datetime(2020, 1, 10), dt.datetime(2020, 1, 12)]


def test_arrow_files_and_named_datasets(spark, tmp_path):
    table = pa.table({"id": ["a", "b"], "timestamp": pa.array([[day(0), day(1)], [day(0)]], pa.list_(pa.timestamp("us"))), "target": [[1.0, 2.0], [3.0]]})
    path = tmp_path / "x.arrow"
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        for b in table.to_batches(max_chunksize=1):
            w.write(b)
    df = datasets.load(spark, str(path))
    assert {r.id: r.target for r in df.collect()} == {"a": [1.0, 2.0], "b": [3.0]}
    datasets.save(df, str(tmp_path / "root" / "org/data" / "cfg"))
    assert datasets.load(spark, "org/data", "cfg", root=str(tmp_path / "root")).count() == 2
    for bad in (lambda: datasets.load(spark, "x.csv"), lambda: datasets.load(spark, "org/none", "cfg")):
        with pytest.raises(ValueError):
            bad()


def two_targets(spark):
    rows = [(k, [day(i) for i in range(n)], [float(i % 5 + i // 5 + o) for i in range(n)], [float(2 * i + o) for i in range(n)], [float(i) for i in range(n)]) for k, n, o in (("b", 20, 1), ("a", 25, 2), ("c", 22, 3))]
    return spark.createDataFrame(rows, "id string, timestamp array<timestamp_ntz>, x array<double>, y array<double>, known array<double>")


def task(**more):
    return Task("d", "two", horizon=3, num_windows=2, seasonality=5, target=["y", "x"], quantile_levels=[0.1, 0.9], eval_metric="MASE", extra_metrics=["SQL", "RMSE"], known_dynamic_columns=["known"], **more)


def test_summary_by_key_and_by_position(spark):
    t = task().use(two_targets(spark))
    model = ForecastingModel.named("Seasonal_Naive")()
    keyed = model.fit_predict(spark, t)
    a = t.evaluation_summary(spark, keyed, "m", 1.0, 2.0, extra_info={"note": 1})
    lists = []
    for i in range(2):
        rows = keyed.filter(F.col("window_idx") == i).orderBy("id").collect()
        lists.append({name: [{"predictions": r["predictions"], "0.1": r["0.1"], "0.9": r["0.9"]} for r in rows if r.target_name == name] for name in "xy"})
    b = t.evaluation_summary(spark, lists, "m", 1.0, 2.0, extra_info={"note": 1})
    assert a == b and a["num_forecasts"] == 12 and a["note"] == 1 and a["test_error"] == a["MASE"]
    # x gains 1 and y gains 10 each season: errors as large as the scale
    assert a["MASE"] == pytest.approx(1.0) and a["RMSE"] == pytest.approx(5.5)


@pytest.mark.parametrize(
    "break_it, message",
    [
        (lambda p: p["x"][1].pop("0.9"), "lack"),
        (lambda p: p.pop("y"), "No predictions of"),
        (lambda p: p["x"][2]["predictions"].pop(), "Not 3 values .* item 2"),
        (lambda p: p["x"][1]["0.1"].pop(), "Not 3 values .*0.1.* item 1"),
        (lambda p: p["y"][0]["0.9"].__setitem__(1, math.inf), "finite.*'0.9' of target 'y', first at item 0"),
        (lambda p: p["y"][2]["predictions"].__setitem__(0, None), "finite.*at item 2"),
        (lambda p: p["x"].pop(), "Expected predictions"),
    ],
)
def test_broken_predictions(spark, break_it, message):
    t = task().use(two_targets(spark))
    good = {n: [{"predictions": [1.0] * 3, "0.1": [0.0] * 3, "0.9": [2.0] * 3} for _ in range(3)] for n in "xy"}
    assert t.clean(spark, good, 0)[1] == 6
    break_it(good)
    with pytest.raises(ValueError, match=message):
        t.clean(spark, good, 0)


def test_number_of_windows_must_match(spark):
    t = task().use(two_targets(spark))
    with pytest.raises(ValueError, match="2 windows"):
        t.evaluation_summary(spark, [{}], "m")


def test_models(spark):
    with pytest.raises(ValueError, match="Unknown model"):
        ForecastingModel.named("none")

    class LastValueModel(PerSeriesModel):
        trained_on = ("two",)

        def predict(self, history, horizon, levels):
            return {"predictions": [history.iloc[-1]] * horizon} | {str(q): [history.iloc[-1] + q] * horizon for q in levels}

    assert LastValueModel.model_name == "lastvalue" and {"naive", "seasonal_naive", "drift", "average", "lastvalue"} <= set(ForecastingModel.available())
    with pytest.raises(ValueError, match="already registered"):
        type("LastValueModel", (PerSeriesModel,), {"predict": lambda *a: {}})
    rows = run(spark, "naive", [task().use(two_targets(spark))]) + run(spark, LastValueModel(), Benchmark([task().use(two_targets(spark))]))
    assert rows[0]["MASE"] == pytest.approx(rows[1]["MASE"]) and [r["trained_on_this_dataset"] for r in rows] == [False, True] and rows[0]["inference_time_s"] > 0


def test_benchmark(tmp_path):
    path = tmp_path / "tasks.yaml"
    path.write_text("tasks:\n- dataset_path: p\n  dataset_config: c\n  horizon: 8\n  seasonality: 4\n- dataset_path: p\n  dataset_config: d\n  num_windows: 2\n")
    pytest.importorskip("yaml")
    b = Benchmark.from_yaml(path)
    assert len(b) == 2 and b[0].seasonality == 4 and b[1].num_windows == 2
    with pytest.raises(ValueError, match="Failed to load"):
        Benchmark.from_yaml(tmp_path / "none.yaml")


def test_adapters(spark):
    df = two_targets(spark).withColumn("kind", F.transform("x", lambda v: F.when(v > 3, "hi").when(v > 2, "mid"))).withColumn("site", F.concat(F.lit("s"), "id"))
    w = windows.split(df, [-3], 3, dynamic=["x", "y", "known", "kind"], static=["site"])
    past, future = windows.past(w, ["x", "y", "known", "kind"], static=["site"]), windows.future(w, ["known", "kind"], static=["site"])
    make = lambda name, **o: adapters.convert(past, future, name, targets=["x", "y"], static=["site"], **o)
    t = make("pandas")
    assert t["past"].count() == 58 and t["future"].count() == 9 and t["static"].columns == ["window_idx", "id", "site"] and "site" not in t["past"].columns
    g = make("entries")
    assert dict(g["past"].dtypes)["x"] == "float" and {r.kind for r in g["past"].select("kind").distinct().collect()} == {-1, 0, 1} and g["prediction"].filter("is_future and x is null").count() == 9
    n = make("unique_id", univariate=True)
    assert {"window_idx", "unique_id", "ds", "y"} <= set(n["past"].columns) and n["past"].select("unique_id").distinct().count() == 6
    assert "item_id" in make("item_id", univariate=True)["future"].columns
    d = make("covariates")["series"]
    assert all(len(r.known) == len(r.x) + 3 for r in d.collect()) and "kind" not in d.columns
    with pytest.raises(KeyError):
        make("nope")
    with pytest.raises(ValueError, match="one target"):
        make("unique_id")
    with pytest.raises(ValueError, match="exists"):
        adapters.as_univariate(past, future, ["x", "y"], "id", "timestamp", "known")


def test_predictions_must_match_one_to_one(spark):
    t = task().use(two_targets(spark))
    f = ForecastingModel.named("naive")().fit_predict(spark, t)
    assert t.evaluation_summary(spark, f, "m")["num_forecasts"] == f.count()
    one = f.limit(1)
    for wrong, side in ((f.unionByName(one), "repeated"), (f.unionByName(one.withColumn("id", F.lit("zz"))), "surplus"), (f.filter("id <> 'a'"), "missing")):
        assert {r.side for r in predictions.unmatched(t.windows(), wrong, ["x", "y"]).collect()} == {side}
        with pytest.raises(ValueError, match="one to one"):
            t.evaluation_summary(spark, wrong, "m")


def test_items_are_ordered_by_id_in_each_window(spark):
    t = task().use(two_targets(spark))
    got = {}
    for r in t.windows(ordered=True).select("window_idx", "id", "item_ord").collect():
        got.setdefault(r.window_idx, {})[r.id] = r.item_ord
    assert len(got) == 2 and all(own == {x: i for i, x in enumerate(sorted(own))} for own in got.values())


def test_unmatched_and_ensemble(spark):
    t = task().use(two_targets(spark))
    f = ForecastingModel.named("naive")().fit_predict(spark, t)
    assert predictions.unmatched(t.windows(), f.filter("id <> 'a'"), ["x", "y"]).groupBy("side").count().collect()[0]["count"] == 4
    three = f.unionByName(f.withColumn("predictions", F.transform("predictions", lambda x: x + 1))).unionByName(f.withColumn("predictions", F.transform("predictions", lambda x: x + 9)))
    e = predictions.ensemble(three, ["window_idx", "id", "target_name"], [0.1, 0.9])
    j = e.alias("e").join(f.alias("f"), ["window_idx", "id", "target_name"]).select(F.col("e.predictions").alias("a"), F.col("f.predictions").alias("b")).collect()
    assert all(x == pytest.approx(y + 1) for r in j for x, y in zip(r.a, r.b))

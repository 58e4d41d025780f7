"""Storage options of tasks, adapters' facts, file sizes, and models that are fitted in Spark."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsmeter.operators import analytics
from tsmeter.plans.model import AutoregressionModel, StatisticalEnsembleModel, run
from tsmeter.plans.task import Task
from tsmeter.sources import datasets


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(name, [float((3 * k) % 7 + k / 5) for k in range(40)], [float(k) for k in range(40)], kind) for name, kind in (("a", "x"), ("b", "y"))]
    df = spark.createDataFrame(rows, "id string, target array<double>, promo array<double>, kind string").withColumn("timestamp", F.sequence(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-09").cast("timestamp_ntz"), F.expr("interval 1 day")))
    path = str(tmp_path_factory.mktemp("data") / "d.parquet")
    df.write.parquet(path)
    return path


def make(path):
    return Task(path, horizon=4, num_windows=2, seasonality=7, eval_metric="MASE", known_dynamic_columns=["promo"], static_columns=["kind"])


def test_storage_options_reach_every_read(spark, stored, monkeypatch):
    seen = []
    load = datasets.load
    monkeypatch.setattr(datasets, "load", lambda s, path, config=None, options=None, root=None: seen.append(options) or load(s, path, config, options, root))
    options = {"fs.s3a.secret.key": "k"}
    task = make(stored)
    list(task.iter_windows(storage_options=options))[0].rows(spark).count()
    options["fs.s3a.secret.key"] = "changed"
    summary = run(spark, "naive", [make(stored)], storage_options={"fs.s3a.secret.key": "k"})[0]
    assert seen == [{"fs.s3a.secret.key": "k"}] * 2 and "secret" not in str(summary)
    task.stored_with({"fs.s3a.secret.key": "other"}).load(spark)
    task.load(spark)
    assert len(seen) == 3


def test_fitted_models_give_summaries(spark, stored):
    for model in (AutoregressionModel(), StatisticalEnsembleModel()):
        row = run(spark, model, [make(stored)])[0]
        assert row["num_forecasts"] == 4 and 0 <= row["test_error"] < 2


def test_adapters_tell_what_libraries_need(spark, stored):
    window = make(stored).window(1)
    c = window.convert("entries", spark=spark)
    assert (c["known"], c["past_only"], c["future_length"], c["freq"]) == (["promo"], [], 4, "D")
    past = window.convert("item_id", spark=spark)["past"]
    assert set(past.columns) == {"window_idx", "item_id", "timestamp", "target", "promo", "kind"}
    assert {(r["item_id"], r["kind"]) for r in past.collect()} == {("a", "x"), ("b", "y")}


def test_oversized_files(spark, tmp_path):
    pd.DataFrame({"x": range(1000)}).to_csv(tmp_path / "large.csv")
    (tmp_path / "small.csv").write_text("x\n1\n")
    got = analytics.oversized_files(spark, str(tmp_path), 100).collect()
    assert [(r["file"], r["bytes"] > 1000) for r in got] == [("large.csv", True)]

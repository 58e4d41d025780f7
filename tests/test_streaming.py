"""Streams give what tables give."""

from pyspark.sql import functions as F

from tsmeter.functions import series
from tsmeter.operators import baselines
from tsmeter.queries import daily, daily_windows
from tsmeter.streaming import scores, stateful


def test_stream_of_actuals(spark, small, tmp_path):
    w = daily_windows(spark, small)
    f = baselines.forecast(w, "naive", ["target"], 7, 7).join(w.select("window_idx", "id", F.col("future.timestamp").alias("timestamp"), series.seasonal_error(F.col("past").getField("target"), 7).alias("scale_abs")), ["window_idx", "id"])
    steps = scores.step_forecasts(f, ("scale_abs",)).persist()
    actuals = daily(spark, small).select("id", F.lit("target").alias("target_name"), "timestamp", F.col("target").alias("y"))
    path = str(tmp_path / "in")
    actuals.filter("day(timestamp) % 2 = 0").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(actuals.schema).parquet(path)
    q = scores.start(stream, steps, "running_sums", str(tmp_path / "ckpt"))
    q.processAllAvailable()
    half = spark.table("running_sums").agg(F.sum("n")).first()[0]
    actuals.filter("day(timestamp) % 2 = 1").coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    rounded = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in scores.scores(df).collect())
    assert 0 < half < 70 and rounded(spark.table("running_sums")) == rounded(scores.error_sums(actuals, steps))


def test_events_to_steps(spark, small):
    out = scores.actuals_from_events(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "value")
    a = {(r.id, r.timestamp): round(r.y, 6) for r in out.collect()}
    assert a == {(r.id, r.timestamp): round(r.target, 6) for r in daily(spark, small).collect()}


def test_state_survives_restarts_and_late_steps(spark, tmp_path):
    """Steps out of order, a gap, nulls, a repeated step and four runs from one checkpoint."""
    import datetime
    import random

    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    rng = random.Random(4)
    values = {(name, k): None if rng.random() < 0.1 else rng.randint(1, 50) / 2 for name in ("a", "b") for k in range(60) if (name, k) not in (("b", 33), ("b", 34))}
    forecast = {(w, name, k): rng.randint(1, 50) / 2 for w, first in ((0, 30), (1, 40)) for name in ("a", "b") for k in range(first, first + 12)}
    table = spark.createDataFrame([(w, name, day(k), p) for (w, name, k), p in forecast.items()], "window_idx int, id string, timestamp timestamp_ntz, p double")
    table.write.parquet(str(tmp_path / "f"))
    own = stateful.session(spark, 2)
    schema = "id string, timestamp timestamp_ntz, y double"
    for number, (low, high) in enumerate(((0, 25), (25, 38), (38, 50), (50, 60))):
        # some steps of each run come with the next one, within the delay
        rows = [(name, day(k), y) for (name, k), y in values.items() if low <= k + 3 * ((k * 7) % 5 == 0 and k < 57) < high or number == 3 and k >= 50 and (k + 3 * ((k * 7) % 5 == 0 and k < 57)) >= 60]
        rng.shuffle(rows)
        spark.createDataFrame(rows + rows[:1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = own.readStream.schema(schema).parquet(str(tmp_path / "in"))
        running = stateful.score_stream(source, own.read.parquet(str(tmp_path / "f")), 7, late="5 days")
        stateful.start(running, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["window_idx"]: r for r in stateful.latest(spark, str(tmp_path / "out")).collect()}
    for w, first in ((0, 30), (1, 40)):
        n, total, scaled = 0, 0.0, 0.0
        for name in ("a", "b"):
            y = [values.get((name, k)) for k in range(60)]
            pairs = [abs(y[k] - y[k - 7]) for k in range(7, first) if y[k] is not None and y[k - 7] is not None]
            own_errors = [abs(y[k] - forecast[w, name, k]) for k in range(first, first + 12) if y[k] is not None]
            n, total, scaled = n + len(own_errors), total + sum(own_errors), scaled + sum(e / (sum(pairs) / len(pairs)) for e in own_errors)
        assert got[w]["n"] == n and abs(got[w]["sum_abs"] - total) < 1e-9 and abs(got[w]["sum_scaled"] - scaled) < 1e-9

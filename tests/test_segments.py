"""Segmented series give what whole arrays give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsmeter.operators import baselines, metrics, segments, windows

SCHEMA = "id string, timestamp timestamp_ntz, target double"


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(5)
    import datetime

    start = datetime.datetime(2020, 1, 1)
    rows = []
    for name, n, step in (("a", 300, 1), ("b", 41, 1), ("c", 1, 1), ("d", 120, 5), ("e", 64, 1)):
        for t in range(n):
            value = None if rng.random() < 0.07 else float("nan") if rng.random() < 0.05 else float(rng.normal())
            rows.append((name, start + datetime.timedelta(hours=t * step + (t > 30) * 400 * (name == "e")), value))
    rng.shuffle(rows)
    return spark.createDataFrame([(a, b, c) for a, b, c in rows], SCHEMA).repartition(3).cache()


def whole(long):
    return long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "target"))).alias("s")).select("id", F.col("s.timestamp").alias("timestamp"), F.col("s.target").alias("target"))


def clean(x):
    return None if x is None or x != x else round(x, 9)


def steps(rows):
    return {(r["window_idx"], r["id"]): ([clean(x) for x in r["past"]["target"]], r["past"]["timestamp"], [clean(x) for x in r["future"]["target"]], r["future"]["timestamp"]) for r in rows}


@pytest.mark.parametrize("size,width", [(16, None), (7, 3_600_000_000 * 50)])
def test_windows_and_scales(spark, long, size, width):
    s = segments.build(long, ["target"], size=size, width=width).cache()
    assert s.agg(F.max(F.size("target"))).first()[0] <= size
    import datetime

    for cutoffs in ((-30, -5, 40), (datetime.datetime(2020, 1, 2, 12), datetime.datetime(2020, 1, 10))):
        cut = segments.cuts(s, cutoffs, 5, min_context=2)
        expected = windows.split(whole(long), cutoffs, 5, min_context=2).cache()
        got = segments.windows(s, cut, 5, 1000, size=size)
        assert steps(got.collect()) == steps(expected.collect()) != {}
        assert steps(segments.windows(s, cut, 5, 9, size=size).collect()) == steps(windows.split(whole(long), cutoffs, 5, min_context=2, max_context=9).collect())
        for season in (7, 33) if size == 16 else (16,):
            f = baselines.forecast(expected, "naive", ["target"], 5)
            want = {(r["window_idx"], r["id"]): (clean(r["scale_abs"]), clean(r["scale_sq"])) for r in metrics.scored_long(expected, f, ["target"], season).collect()}
            found = {(r["window_idx"], r["id"]): (clean(r["scale_abs"]), clean(r["scale_sq"])) for r in segments.seasonal_errors(s, cut, "target", season, size).collect()}
            assert found == want


def test_empty_and_short(spark, long):
    none = segments.build(long.limit(0), ["target"])
    assert none.count() == 0 and segments.cuts(none, (-3,), 2).count() == 0
    short = segments.build(long.filter("id = 'c'"), ["target"], size=4)
    assert [(r["start"], r["n"], r["length"]) for r in short.collect()] == [(0, 1, 1)]
    assert segments.cuts(short, (-1, 0, 5), 1).count() == 0


def test_a_long_series_is_spread(spark):
    """No task reads more than its share of one long series."""
    n, size = 200_000, 2048
    one = spark.range(0, n, 1, 8).select(F.lit("x").alias("id"), F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("timestamp"), (F.col("id") % 10).cast("double").alias("target"))
    s = segments.build(one, ["target"], size=size)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small tasks are joined
    per_task = [r["n"] for r in s.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("n").alias("n")).collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == n and max(per_task) < 0.6 * n
    cut = segments.cuts(s, (-24,), 24)
    assert segments.seasonal_errors(s, cut, "target", 7, size).first()["scale_abs"] == pytest.approx(np.abs(np.arange(7, n - 24) % 10 - np.arange(n - 31) % 10).mean())

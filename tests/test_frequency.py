"""Frequencies told by expressions are those that pandas tells."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tsmeter.functions import frequency

NAMES = [
    "D", "2D", "7D", "14D", "W-SUN", "W-WED", "2W-FRI", "B", "ME", "MS", "BME", "BMS", "2ME", "5MS", "QE", "QS-OCT", "QE-JAN", "QS-FEB", "BQE-DEC", "BQS-NOV", "2QS-JAN", "YE", "YS", "YE-JUN", "YS-APR", "2YE-DEC", "BYE-DEC", "BYS-JAN", "WOM-1MON", "WOM-2TUE", "WOM-4FRI",
    "h", "3h", "24h", "36h", "15min", "90min", "s", "10s", "1500ms", "250us", "bh", "12MS", "6ME",
]


def test_names_equal_pandas(spark):
    rng = random.Random(6)
    series = []
    for k in range(1200):
        start = pd.Timestamp("1999-01-01") + pd.Timedelta(days=rng.randint(0, 9000), hours=rng.choice([0, 0, 9, 10]))
        t = list(pd.date_range(start, periods=rng.randint(2, 30), freq=rng.choice(NAMES)))
        if k % 6 == 0 and len(t) > 4:  # a step less, a step twice, a step moved
            j = rng.randint(1, len(t) - 2)
            t = rng.choice([t[:j] + t[j + 1 :], t[: j + 1] + t[j:], [*t[:j], t[j] + pd.Timedelta(days=1), *t[j + 1 :]]])
        series.append((k, [x.to_pydatetime() for x in t]))
    df = spark.createDataFrame(series, "k int, t array<timestamp_ntz>")
    named = df.select("k", frequency.name_of("t").alias("name"))
    assert "Python" not in named._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["name"] for r in named.collect()}
    want = {k: frequency.infer(t) for k, t in series}
    assert {k: (got[k], want[k], [str(x) for x in t]) for k, t in series if got[k] != want[k]} == {}
    assert len({x for x in want.values() if x}) > 40


def test_regularity_of_odd_series(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [pd.Timestamp("2020-01-01").to_pydatetime()] * 3), (3, [None, None, None])], "k int, t array<timestamp_ntz>")
    assert [r["regular"] for r in frequency.with_regularity(df, "t").orderBy("k").collect()] == [False] * 4
    up = df.limit(0).withColumn("x", F.lit(1))
    assert frequency.with_regularity(up, "t").count() == 0

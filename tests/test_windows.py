"""Golden cases of splits, shapes and checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsmeter.functions import frequency, series
from tsmeter.operators import reshape, validate, windows


def day(i, start="2020-01-01"):
    return dt.datetime.fromisoformat(start) + dt.timedelta(days=i)


def univariate(spark, lengths, starts=None, static=False):
    rows = [(chr(65 + k), [day(i, (starts or {}).get(k, "2020-01-01")) for i in range(n)], list(range(n)), 10 * k) for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id string, timestamp array<timestamp_ntz>, target array<bigint>, static int")
    return df if static else df.drop("static")


def parts(w):
    return {r.id: (list(r.past.target), list(r.future.target)) for r in w.collect()}


@pytest.mark.parametrize(
    "length, cutoff, horizon, least, past, future",
    [(10, 5, 3, 1, range(5), range(5, 8)), (10, -3, 2, 1, range(7), (7, 8)), (10, 2, 3, 2, (0, 1), (2, 3, 4)), (10, 8, 2, 1, range(8), (8, 9)), (10, 5, 5, 1, range(5), range(5, 10)), (5, 1, 2, 1, (0,), (1, 2)), (5, 0, 3, 0, (), (0, 1, 2))],
)
def test_integer_cutoffs(spark, length, cutoff, horizon, least, past, future):
    got = parts(windows.split(univariate(spark, [length]), [cutoff], horizon, min_context=least))
    assert got == {"A": (list(past), list(future))}


@pytest.mark.parametrize("length, cutoff, horizon, past, future", [(10, "2020-01-05", 3, range(5), (5, 6, 7)), (5, "2020-01-02T12:00:00", 2, (0, 1), (2, 3))])
def test_timestamp_cutoffs_are_inclusive(spark, length, cutoff, horizon, past, future):
    got = parts(windows.split(univariate(spark, [length]), [dt.datetime.fromisoformat(cutoff)], horizon))
    assert got == {"A": (list(past), list(future))}


@pytest.mark.parametrize("lengths, cutoff, horizon, least, kept", [([10, 10], 5, 3, 3, "AB"), ([10, 3], 5, 2, 4, "A"), ([10, 6], 5, 3, 1, "A"), ([20, 5, 18, 11], 10, 5, 8, "AC"), ([5, 5], 3, 10, 1, ""), ([10], 5, 2, 6, "")])
def test_length_filter(spark, lengths, cutoff, horizon, least, kept):
    assert sorted(parts(windows.split(univariate(spark, lengths), [cutoff], horizon, min_context=least))) == list(kept)


@pytest.mark.parametrize("length, cutoff, most, past", [(20, 15, 5, range(10, 15)), (10, 5, 100, range(5)), (10, 5, None, range(5))])
def test_context_length(spark, length, cutoff, most, past):
    assert parts(windows.split(univariate(spark, [length]), [cutoff], 2, max_context=most))["A"][0] == list(past)


@pytest.mark.parametrize("lengths, starts, cutoff, sizes", [([15, 20, 10], None, 7, [7, 7, 7]), ([10, 15, 8], None, -3, [7, 12, 5]), ([10, 15, 10], {2: "2020-01-03"}, "2020-01-07", [7, 7, 5])])
def test_ragged(spark, lengths, starts, cutoff, sizes):
    c = dt.datetime.fromisoformat(cutoff) if isinstance(cutoff, str) else cutoff
    got = parts(windows.split(univariate(spark, lengths, starts), [c], 2))
    assert [len(got[i][0]) for i in "ABC"] == sizes


def test_all_windows_and_columns_in_one_plan(spark):
    df = univariate(spark, [50 + i % 10 for i in range(26)], static=True).withColumn("text", F.transform("target", lambda x: x.cast("string")))
    w = windows.split(df, [30, 31], 10, dynamic=["target", "text"], static=["static"], min_context=20)
    rows = w.collect()
    assert len(rows) == 52 and all(len(r.past.target) == 30 + r.window_idx and len(r.future.text) == 10 for r in rows)
    assert all(r.future.text == [str(x) for x in r.future.target] and r.static == 10 * (ord(r.id) - 65) for r in rows)
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString()
    f = windows.future(w, [], static=["static"])
    assert f.columns == ["window_idx", "id", "timestamp", "static"] and windows.ground_truth(w, ["target"]).columns[-1] == "target"
    assert windows.dropped(df, w, 2).filter("dropped = 0 and kept = 26").count() == 2


def long_rows(n=5, steps=4):
    return [(f"id_{i}", day(t), float(i * 100 + t), "ABC"[i % 3]) for i in range(n) for t in range(steps)]


SCHEMA = "item_id string, timestamp timestamp_ntz, target double, category string"


def test_long_to_nested(spark):
    df = spark.createDataFrame(long_rows(), SCHEMA)
    for source in (df, df.orderBy(F.rand(1))):
        got = {r.item_id: r for r in reshape.long_to_nested(source, "item_id", static_columns=["category"]).collect()}
        assert got["id_0"].target == [0, 1, 2, 3] and got["id_1"].target == [100, 101, 102, 103] and got["id_4"].category == "B"
    assert reshape.is_long(df, "item_id", "timestamp") and reshape.column_roles(reshape.long_to_nested(df, "item_id"), "item_id") == (["target", "category"], [])
    with pytest.raises(ValueError, match="timestamp type"):
        reshape.long_to_nested(df.withColumn("timestamp", F.lit("2020-01-01")), "item_id")
    text = reshape.long_to_nested(df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd")), "item_id", string_input=True)
    assert text.filter("item_id = 'id_2'").first().target == [200, 201, 202, 203]


def test_nulls_keep_their_place(spark):
    df = spark.createDataFrame([("a", day(0), None), ("a", day(1), 2.0), ("a", day(2), None)], "id string, timestamp timestamp_ntz, target double")
    nested = reshape.long_to_nested(df)
    assert nested.first().target == [None, 2.0, None]
    assert [r.target for r in reshape.nested_to_long(nested).orderBy("pos").collect()] == [None, 2.0, None]


def test_melt(spark):
    df = spark.createDataFrame([(k, [day(i) for i in range(n)], [float(i) for i in range(n)], [10.0 * i for i in range(n)], [1.0] * n) for k, n in (("A", 3), ("B", 5))], "id string, timestamp array<timestamp_ntz>, X array<double>, Y array<double>, cov array<double>")
    got = reshape.melt_targets(df, ["X", "Y"]).orderBy("id").collect()
    assert [r.id for r in got] == ["A_X", "A_Y", "B_X", "B_Y"] and [len(r.target) for r in got] == [3, 3, 5, 5] and all(len(r.cov) == len(r.target) for r in got)
    assert reshape.melt_targets(df, "__ALL__").count() == 6
    assert [r.item_ord for r in reshape.ordered(reshape.melt_targets(df.filter("id = 'B'"), ["X", "Y"])).orderBy("id").collect()] == [0, 1]
    with pytest.raises(ValueError, match="Missing target"):
        reshape.melt_targets(df, ["Z"])


def test_item_order_is_by_bytes(spark):
    df = spark.createDataFrame([(i,) for i in ["2", "10", "b", "Z", "é"]], "id string")
    assert {r.id: r.item_ord for r in reshape.ordered(df).collect()} == {"10": 0, "2": 1, "Z": 2, "b": 3, "é": 4}


def test_combine_and_flat(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "item_ord long, v double")
    got = {(r.item_ord, r.target_name): r.v for r in reshape.combine_univariate(df, ["X", "Y"]).collect()}
    assert got == {(i, t): 2.0 * i + k for i in range(3) for k, t in enumerate("XY")}
    with pytest.raises(Exception, match="divisible"):
        reshape.combine_univariate(df.limit(5), ["X", "Y"]).collect()
    flat = spark.createDataFrame([(i, float(i)) for i in range(8)], "pos long, predictions double")
    nested = {(r.item_ord, r.target_name): r.predictions for r in reshape.flat_to_nested(flat, 2, ["X", "Y"]).collect()}
    assert nested == {(0, "X"): [0, 1], (0, "Y"): [2, 3], (1, "X"): [4, 5], (1, "Y"): [6, 7]}


def test_validation(spark):
    good = univariate(spark, [5, 6])
    validate.validate(good)
    bad = {
        "Missing": good.drop("timestamp"),
        "scalar": good.withColumn("id", F.array("id")),
        "array of timestamps": good.withColumn("timestamp", F.transform("timestamp", lambda t: t.cast("string"))),
        "unique": good.union(good),
        "dynamic": good.drop("target"),
        "irregular": good.withColumn("timestamp", F.concat(F.slice("timestamp", 1, 4), F.transform(F.slice("timestamp", 5, 9), lambda t: t + F.expr("interval 5 hours")))),
        "Lengths of entries": good.withColumn("target", F.slice("target", 1, 3)),
    }
    for message, df in bad.items():
        with pytest.raises(ValueError, match=message):
            validate.validate(df)
    with pytest.raises(ValueError, match=r"\['x'\]"):
        validate.check_columns(good, ["x", "target"], [], "id", "timestamp")


@pytest.mark.parametrize("freq", ["D", "h", "15min", "W-SUN", "MS", "ME", "QS", "QE", "YS", "2D", "B", "QS-NOV"])
def test_regular_frequencies(spark, freq):
    import pandas as pd

    t = [x.to_pydatetime() for x in pd.date_range("2020-01-01", periods=14, freq=freq)]
    df = spark.createDataFrame([("good", t), ("bad", [*t[:5], *t[6:]]), ("short", t[:2])], "id string, timestamp array<timestamp_ntz>")
    got = {r.id: r.regular for r in frequency.with_regularity(df, "timestamp").collect()}
    assert got == {"good": True, "bad": False, "short": False}


def test_seasons():
    assert [frequency.season_of(f) for f in ("h", "D", "ME", "QS", "15min", "W-SUN", "YE", "5D")] == [24, 7, 12, 4, 96, 1, 1, 1]
    assert frequency.seconds_of("15min") == 900 and frequency.period_alias("ME") == "M" and frequency.period_alias("QE-NOV") == "Q-NOV"


@pytest.mark.parametrize("values, absolute, square", [([1.0], None, None), ([1.0, 2.0, None, 4.0, 5.0], 2.0, 4.0), ([None] * 4, None, None), ([1.0, 2, 3, 4, 5, 6], 2.0, 4.0), ([1.0, 2.0], None, None), ([10.0 * i for i in range(1, 10)], 20.0, 400.0), ([float("nan"), 1.0, 3.0, 2.0], 1.0, 1.0)])
def test_seasonal_error(spark, values, absolute, square):
    df = spark.createDataFrame([([None if v is None else float(v) for v in values],)], "y array<double>")
    r = df.select(series.seasonal_error("y", 2).alias("a"), series.seasonal_error("y", 2, True).alias("s")).first()
    assert (r.a, r.s) == (absolute, square)


def test_fills_and_padding(spark):
    df = spark.createDataFrame([([None, 1.0, None, float("nan"), 4.0, None],), ([None, None],)], "y array<double>")
    r = df.select(series.forward_fill("y").alias("f"), series.backward_fill("y").alias("b"), series.fill("y").alias("z"), series.left_pad("y", 8).alias("p"), series.tail("y", 2).alias("t")).collect()
    assert r[0].f == [None, 1, 1, 1, 4, 4] and r[0].b == [1, 1, 4, 4, 4, None] and r[0].z == [1, 1, 1, 1, 4, 4] and len(r[0].p) == 8 and r[0].t == [4.0, None]
    assert r[1].z == [0, 0] and r[1].f == [None, None]
    c = spark.createDataFrame([([1.0, 2.0], [-1.0, 3.0]), ([-1.0, 2.0], [-1.0, 3.0])], "y array<double>, p array<double>")
    assert [x.c for x in c.select(series.clamp_like("y", "p").alias("c")).collect()] == [[0, 3], [-1, 3]]


def test_fingerprint_is_stable(spark):
    df = univariate(spark, [5, 9, 7, 6, 8])
    a = reshape.fingerprint(df)
    assert a and a == reshape.fingerprint(df.repartition(3)) != reshape.fingerprint(df.limit(4))


def test_fingerprint_sees_every_cell(spark):
    rows = [(f"s{i}", i, float(i), None if i % 3 else "x", [1.0, None, float("nan")]) for i in range(40)]
    schema = "id string, k int, v double, s string, y array<double>"
    digest = lambda r: reshape.fingerprint(spark.createDataFrame(r, schema))
    base = digest(rows)
    assert base == digest(rows[::-1]) == reshape.fingerprint(spark.createDataFrame(rows, schema).repartition(7))
    middle = rows[20]
    for changed in (("z", *middle[1:]), (middle[0], 21, *middle[2:]), (*middle[:2], None, *middle[3:]), (*middle[:3], "", middle[4]), (*middle[:4], [1.0, float("nan"), None])):
        assert digest([*rows[:20], changed, *rows[21:]]) != base
    assert digest(rows + rows[:1]) != base != digest(rows[1:]) and digest([]) is not None
    whole, one, two = (reshape.content_sums(spark.createDataFrame(r, schema)).first() for r in (rows, rows[:13], rows[13:]))
    assert [(x + y) % m for x, y, m in zip(one[1:], two[1:], reshape.MODULI)] == list(whole[1:])

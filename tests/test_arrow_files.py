"""The Arrow source and sink: round trips, pruned batches, folders and globs, failed jobs."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsmeter.sources import arrow_files, datasets


@pytest.fixture(scope="module")
def orders(spark, small):
    return spark.read.parquet(f"{small}/orders.parquet").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz")).withColumn("v", F.array(F.lit(1.5), F.lit(None)))


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip_append_and_overwrite(spark, orders, tmp_path):
    path = str(tmp_path / "o.arrow")
    datasets.save(orders.repartition(3), path, "append")
    assert rows(datasets.load(spark, path)) == rows(orders)
    datasets.save(orders.limit(5), path, "append")
    assert datasets.load(spark, path).count() == orders.count() + 5
    datasets.save(orders.limit(7), path, "overwrite")
    assert datasets.load(spark, path).count() == 7
    assert sorted(f for f in os.listdir(path) if f.endswith(".arrow")) == sorted(json.loads((tmp_path / "o.arrow" / arrow_files.MANIFEST).read_text())["files"])
    with pytest.raises(ValueError):
        datasets.save(orders, path, "error")


def test_filters_prune_batches(spark, orders, tmp_path):
    path = str(tmp_path / "o.arrow")
    datasets.save(orders.repartitionByRange(6, "o_orderdate").sortWithinPartitions("o_orderdate"), path, "append")
    middle = orders.agg(F.expr("percentile_approx(o_orderdate, 0.9)")).first()[0]
    every = datasets.load(spark, path)
    for where, less in (([("o_orderdate", ">", middle)], True), ([("o_orderkey", "<", 0)], True), ([("o_orderpriority", "=", "none")], True), ([("o_orderkey", "in", [1, 7]), ("o_orderkey", ">=", 2)], False)):
        some = arrow_files.read(spark, path, where=where)
        want = orders
        for c, sign, v in where:
            want = want.filter(F.col(c).isin(v) if sign == "in" else arrow_files.SIGNS[sign](F.col(c), F.lit(v)))
        assert rows(some) == rows(want)
        assert not less or some.rdd.getNumPartitions() < every.rdd.getNumPartitions()
        # a filter on one DataFrame does not reach another use of it
        assert every.filter(F.col("o_orderkey") < 0).union(every).count() == orders.count() == every.count()
    narrow = arrow_files.read(spark, path, ["o_orderkey", "at"])
    assert narrow.columns == ["o_orderkey", "at"] and rows(narrow) == rows(orders.select("o_orderkey", "at"))


def test_folders_globs_and_streams(spark, tmp_path):
    for folder, k in (("a", 1), ("a", 2), ("b", 3)):
        (tmp_path / folder).mkdir(exist_ok=True)
        table = pa.table({"id": [f"s{k}"], "x": [k]})
        with pa.ipc.new_file(str(tmp_path / folder / f"{k}.arrow"), table.schema) if k != 2 else pa.ipc.new_stream(str(tmp_path / folder / f"{k}.arrow"), table.schema) as w:
            w.write_table(table)
    read = lambda p: sorted(r["x"] for r in datasets.load(spark, p).collect())
    assert read(f"{tmp_path}/*/*.arrow") == [1, 2, 3] and read(f"file://{tmp_path}/a/[12].arrow") == [1, 2] and read(f"{tmp_path}/b/3.arrow") == [3]
    arrow_files.register(spark)
    assert sorted(r["x"] for r in spark.read.format("arrow_file").load(f"file://{tmp_path}/a").collect()) == [1, 2]
    with pytest.raises(Exception, match="No file matches"):
        read(f"{tmp_path}/none*.arrow")


def test_a_failed_job_leaves_no_rows(spark, orders, tmp_path):
    path = str(tmp_path / "o.arrow")
    datasets.save(orders.limit(3), path, "append")
    broken = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") > 100, F.raise_error(F.lit("no"))).otherwise(F.col("o_orderkey")).cast("long"))
    with pytest.raises(Exception):
        datasets.save(broken.repartition(4), path, "append")
    assert datasets.load(spark, path).count() == 3


def test_bounds_of_odd_columns():
    batch = pa.record_batch({"n": pa.array([None, None], pa.int64()), "f": [1.0, float("nan")], "b": [True, False], "s": ["b", "a"], "t": pa.array([0, 1], pa.timestamp("us")), "z": pa.array([0, 1], pa.timestamp("us", "UTC"))})
    assert arrow_files.bounds(batch) == {"s": ["a", "b"], "t": ["1970-01-01T00:00:00", "1970-01-01T00:00:00.000001"]}
    assert arrow_files.possible({"s": ["a", "b"]}, [["s", "=", "b"], ["x", ">", 3], ["s", "=", None], ["s", "<", "b"], ["s", ">=", "b"]])
    assert not any(arrow_files.possible({"s": ["a", "b"]}, [w]) for w in (["s", "in", ["c", "d"]], ["s", "<", "a"], ["s", ">", "b"], ["s", "=", "c"]))

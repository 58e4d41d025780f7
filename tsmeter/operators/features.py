"""Feature transforms over long tables, as window expressions on the series' key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import known
from .reshape import ordered


def _ordered(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def forward_fill(df: DataFrame, value: str, keys: Sequence[str] = ("id",), order: str = "timestamp", otherwise: float | None = None) -> DataFrame:
    out = F.last(known(value), ignorenulls=True).over(_ordered(keys, order))
    return df.withColumn(value, out if otherwise is None else F.coalesce(out, F.lit(float(otherwise))))


def backward_fill(df: DataFrame, value: str, keys: Sequence[str] = ("id",), order: str = "timestamp") -> DataFrame:
    return df.withColumn(value, F.first(known(value), ignorenulls=True).over(_ordered(keys, order).rowsBetween(0, Window.unboundedFollowing)))


def zero_if_all_missing(df: DataFrame, value: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    return df.withColumn(value, F.when(F.count(known(value)).over(Window.partitionBy(*keys)) == 0, F.lit(0.0)).otherwise(known(value)))


def differences(df: DataFrame, value: str, lag: int = 1, name: str = "difference", keys: Sequence[str] = ("id",), order: str = "timestamp") -> DataFrame:
    return df.withColumn(name, known(value) - known(F.lag(value, lag).over(_ordered(keys, order))))


def lags(df: DataFrame, value: str, steps: Sequence[int], keys: Sequence[str] = ("id",), order: str = "timestamp") -> DataFrame:
    w = _ordered(keys, order)
    for n in steps:
        df = df.withColumn(f"{value}_lag{n}", F.lag(value, n).over(w))
    return df


def rolling_mean(df: DataFrame, value: str, size: int, name: str = "rolling_mean", keys: Sequence[str] = ("id",), order: str = "timestamp") -> DataFrame:
    """Over the last ``size`` steps, this one included, from the first step on."""
    return df.withColumn(name, F.avg(known(value)).over(_ordered(keys, order).rowsBetween(1 - size, 0)))


def local_scale(df: DataFrame, value: str, name: str = "scaled", keys: Sequence[str] = ("id",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    x = known(value)
    return df.withColumn(name, F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def time_index(df: DataFrame, name: str = "time_idx", keys: Sequence[str] = ("id",), order: str = "timestamp") -> DataFrame:
    """Whole numbers from 0 in time order, in place of timestamps."""
    return df.withColumn(name, F.row_number().over(_ordered(keys, order)) - 1)


def with_statics(df: DataFrame, statics: DataFrame, key: str = "id") -> DataFrame:
    """A left join on the key; Spark broadcasts the static side where its size allows."""
    return df.join(statics, key, "left")


def category_codes(df: DataFrame, columns: Sequence[str], scope: DataFrame | None = None, missing: int | None = -1) -> DataFrame:
    """Strings as ordinal codes: the rank from 0 among the distinct values (byte order).

    ``scope``: where the values come from (default: the rows themselves); give the union
    of past and future for common codes.  A null gets ``missing``.  Values are ranked
    after they are made distinct; the join back is on the value.
    """
    for c in columns:
        values = (scope if scope is not None else df).select(F.col(c).alias("_v")).filter("_v is not null").distinct()
        codes = ordered(values, "_v").withColumn("_code", F.col("item_ord").cast("int")).drop("item_ord")
        df = df.join(codes, df[c] == codes["_v"], "left").withColumn(c, F.coalesce("_code", F.lit(missing))).drop("_v", "_code")
    return df


def lengths(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))


def length_statistics(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return lengths(df, keys).agg(F.median("length").alias("median_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.count(F.lit(1)).alias("n_series"))


def keep_long(df: DataFrame, at_least: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Only series of at least so many steps."""
    return df.join(lengths(df, keys).filter(F.col("length") >= at_least), list(keys), "left_semi")

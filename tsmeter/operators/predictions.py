"""Predictions: accepted forms, checks, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(levels: Sequence[float] = ()) -> T.StructType:
    """``predictions`` and an array column for each level, named by the level."""
    return T.StructType([T.StructField(c, T.ArrayType(T.DoubleType()), False) for c in ["predictions", *map(str, levels)]])


def normalise(spark: SparkSession, predictions, targets: Sequence[str], window_idx: int, levels: Sequence[float] = ()) -> DataFrame:
    """One window's predictions as window_idx, target_name, id or item_ord, arrays.

    Accepts a DataFrame with ``target_name`` (and id or item_ord), a DataFrame or list of
    dicts for the first target, or a dict of those by target.  Lists are matched by
    position: the order of ids.
    """
    names = ["predictions", *map(str, levels)]

    def one(part, target: str) -> DataFrame:
        if isinstance(part, list):
            for i, row in enumerate(part):
                missing = sorted(set(names) - set(row))
                if missing:
                    raise ValueError(f"{target!r}: the predictions lack {missing}; they need {sorted(names)}")
            kind = T.StructType([T.StructField("item_ord", T.LongType()), *schema(levels).fields])
            for f in kind.fields:
                f.nullable = True
            rows = [(i, *([None if v is None else float(v) for v in row[n]] for n in names)) for i, row in enumerate(part)]
            part = spark.createDataFrame(rows, kind)
        if not isinstance(part, DataFrame):
            raise ValueError(f"Predictions must be a DataFrame, a list of dicts or a dict of those (got {type(part)})")
        missing = sorted(set(names) - set(part.columns))
        if missing:
            raise ValueError(f"{target!r}: the predictions lack {missing}; they need {sorted(names)}")
        if not {"id", "item_ord"} & set(part.columns):
            raise ValueError("A DataFrame of predictions needs an id or item_ord column")
        keys = [c for c in ("id", "item_ord") if c in part.columns]
        return part.select(F.lit(window_idx).alias("window_idx"), F.lit(target).alias("target_name"), *keys, *(F.col(f"`{n}`").cast("array<double>").alias(n) for n in names))

    if isinstance(predictions, DataFrame) and "target_name" in predictions.columns:
        keys = [c for c in ("id", "item_ord") if c in predictions.columns]
        missing = sorted(set(names) - set(predictions.columns))
        if missing:
            raise ValueError(f"The predictions lack {missing}; they need {sorted(names)}")
        return predictions.select(F.lit(window_idx).alias("window_idx"), "target_name", *keys, *(F.col(f"`{n}`").cast("array<double>").alias(n) for n in names))
    parts = predictions if isinstance(predictions, dict) else {targets[0]: predictions}
    missing = sorted(set(targets) - set(parts))
    if missing:
        raise ValueError(f"No predictions of the targets {missing}, only of {sorted(parts)}")
    frames = [one(part, t) for t, part in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def problems(predictions: DataFrame, horizon: int, levels: Sequence[float] = (), key: str = "item_ord") -> DataFrame:
    """target_name, column, wrong_length, not_finite (first bad key of each), n_rows.

    Every column is checked; nulls count as not finite.  One aggregate.
    """
    names = ["predictions", *map(str, levels)]
    each = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("v")) for n in names))
    rows = predictions.select("window_idx", "target_name", key, F.explode(each).alias("_c")).select("window_idx", "target_name", key, "_c.column", "_c.v")
    bad_length = F.coalesce(F.size("v") != horizon, F.lit(True))
    bad_value = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.groupBy("window_idx", "target_name", "column").agg(F.min(F.when(bad_length, F.col(key))).alias("wrong_length"), F.min(F.when(bad_value, F.col(key))).alias("not_finite"), F.count(F.lit(1)).alias("n_rows"))


def validate(predictions: DataFrame, targets: Sequence[str], horizon: int, levels: Sequence[float] = (), key: str = "item_ord") -> int:
    """Raises ValueError for missing targets, wrong lengths and values that are not
    finite; returns the number of forecasts.  Runs one job."""
    found = problems(predictions, horizon, levels, key).orderBy("window_idx", "target_name", "column").collect()  # windows x targets x levels rows
    missing = sorted(set(targets) - {r["target_name"] for r in found})
    if missing and found:
        raise ValueError(f"No predictions of the targets {missing}")
    for r in found:
        if r["wrong_length"] is not None:
            raise ValueError(f"Not {horizon} values in column '{r['column']}' of target '{r['target_name']}', first at item {r['wrong_length']}")
    for r in found:
        if r["not_finite"] is not None:
            raise ValueError(f"Not every value is finite in column '{r['column']}' of target '{r['target_name']}', first at item {r['not_finite']}")
    return sum(r["n_rows"] for r in found if r["column"] == "predictions")


def unmatched(windows: DataFrame, predictions: DataFrame, targets: Sequence[str], key: str = "id") -> DataFrame:
    """Keys that do not match one to one: side is 'missing' (no prediction), 'surplus' (no
    series or target) or 'repeated' (several predictions).  One join, one job."""
    on = ["window_idx", key, "target_name"]
    want = windows.select("window_idx", key, F.explode(F.array(*(F.lit(t) for t in targets))).alias("target_name")).withColumn("wanted", F.lit(True))
    have = predictions.groupBy(*on).agg(F.count(F.lit(1)).alias("given"))
    side = F.when(F.col("given").isNull(), "missing").when(F.col("wanted").isNull(), "surplus").when(F.col("given") > 1, "repeated")
    return want.join(have, on, "full").select(*on, side.alias("side")).filter("side is not null")


def ensemble(predictions: DataFrame, by: Sequence[str], levels: Sequence[float] = ()) -> DataFrame:
    """Step-wise medians over models of the arrays."""
    names = ["predictions", *map(str, levels)]
    steps = predictions.select(*by, F.posexplode(F.arrays_zip(*(F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(names)))).alias("_step", "_v"))
    medians = steps.groupBy(*by, "_step").agg(*(F.median(F.col("_v")[f"v{i}"]).alias(f"v{i}") for i in range(len(names))))
    lists = medians.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_step", *(f"v{i}" for i in range(len(names)))))).alias("_s"))  # horizon rows of a group
    return lists.select(*by, *(F.col("_s").getField(f"v{i}").alias(n) for i, n in enumerate(names)))

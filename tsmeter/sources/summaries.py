"""Evaluation summaries from files, lists and DataFrames, in one schema."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import RESULT_TYPES

#: Former names of task columns (fixed values).
RENAMED = {
    "num_rolling_windows": "num_windows",
    "rolling_step_size": "window_step_size",
    "cutoff": "initial_cutoff",
    "target_column": "target",
    "multiple_target_columns": "generate_univariate_targets_from",
}


def python_list(levels: Column) -> Column:
    """A list of numbers as Python prints it, rounded to four places; null as []."""
    parsed = F.from_json(F.coalesce(levels, F.lit("[]")), "array<double>")
    number = lambda x: F.regexp_replace(F.format_string("%.4f", x), r"(\.\d+?)0+$", "$1")
    return F.concat(F.lit("["), F.array_join(F.transform(parsed, number), ", "), F.lit("]"))


def _one(spark: SparkSession, summary) -> DataFrame:
    if isinstance(summary, DataFrame):
        df = summary
    elif isinstance(summary, list) and summary and isinstance(summary[0], dict):
        df = _from_dicts(spark, summary)
    elif isinstance(summary, (str, Path)):
        path = str(summary)
        if path.endswith(".json"):
            df = spark.read.option("multiLine", True).json(path)
        elif path.endswith(".csv"):
            df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        else:
            raise ValueError(f"Unable to load summaries from {path!r}: the path must end with '.json' or '.csv'")
    else:
        raise ValueError(f"Invalid summary {type(summary)}: expected a DataFrame, a list of dicts or a path")
    versions = [c for c in df.columns if c.endswith("_version") and c != "engine_version"]
    if len(versions) == 1 and "engine_version" not in df.columns:
        df = df.withColumnRenamed(versions[0], "engine_version")
    for old, new in RENAMED.items():
        if old in df.columns and new in df.columns:
            raise ValueError(f"Both the former name {old!r} and {new!r} are columns of the summary")
    return df.withColumnsRenamed(RENAMED)


def _from_dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    plain = lambda v: v if v is None or isinstance(v, (bool, int, float, str)) else str(v)
    kinds = {}
    for n in names:
        values = [r.get(n) for r in rows if r.get(n) is not None]
        number = values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
        kinds[n] = "boolean" if values and all(isinstance(v, bool) for v in values) else "double" if number else "string"
    cast = {"boolean": lambda v: v, "double": float, "string": lambda v: str(plain(v))}
    data = [tuple(None if r.get(n) is None else cast[kinds[n]](r[n]) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def load(spark: SparkSession, summaries) -> DataFrame:
    """One DataFrame of a summary or a list of them, with the columns of RESULT_TYPES.

    Each file is read by itself (headers may differ) and matched by column name.
    """
    many = isinstance(summaries, Sequence) and not isinstance(summaries, str) and not (summaries and isinstance(summaries[0], dict))
    frames = [_one(spark, s) for s in (summaries if many else [summaries])]
    strings = lambda df: df.select(*(F.col(f"`{c}`").cast(RESULT_TYPES.get(c) if RESULT_TYPES.get(c) not in ("bigint",) else "double").alias(c) if c in RESULT_TYPES else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    out = strings(frames[0])
    for f in frames[1:]:
        out = out.unionByName(strings(f), allowMissingColumns=True)
    missing = sorted(set(RESULT_TYPES) - set(out.columns))
    if missing:
        warnings.warn(f"Columns {missing} are missing from summaries, filling them with null", stacklevel=2)
    out = out.withColumns({c: F.lit(None).cast(RESULT_TYPES[c]) for c in missing}) if missing else out
    out = out.withColumn("quantile_levels", python_list(F.col("quantile_levels")))
    return out.withColumns({c: F.col(c).cast(k) for c, k in RESULT_TYPES.items()})


def with_metric(summaries: DataFrame, metric: str) -> DataFrame:
    """A free metric column as double."""
    return summaries.withColumn(metric, F.col(f"`{metric}`").cast("double"))


def add_constant(df: DataFrame, name: str, value: str, overwrite: bool = False) -> DataFrame:
    """A constant column; ValueError if it holds values already, unless they may go."""
    if name in df.columns and not overwrite and df.filter(F.col(name).isNotNull()).limit(1).count():
        raise ValueError(f"Column {name!r} holds values already")
    return df.withColumn(name, F.lit(value))


def literal(text: str):
    """A Python or JSON literal."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return json.loads(text)

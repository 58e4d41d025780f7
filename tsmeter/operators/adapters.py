"""Input data in the shapes that forecasting libraries read, as DataFrames.

Each adapter takes the past and future of windows (nested, see ``windows``) and gives
tables in one layout, after whose key it is named; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frequency
from . import features
from .reshape import melt_targets, nested_to_long, statics

Tables = dict[str, DataFrame | list[str] | str | int | None]
KEYS = ("window_idx",)


def _long(df: DataFrame, id_column: str, timestamp_column: str) -> DataFrame:
    keep = [k for k in KEYS if k in df.columns]
    return nested_to_long(df, id_column, timestamp_column, keep=keep, position=None)


def _statics(past: DataFrame, id_column: str, static: Sequence[str]) -> DataFrame | None:
    keep = [k for k in KEYS if k in past.columns]
    return past.select(*keep, F.col(id_column).cast("string").alias(id_column), *static) if static else None


def nested(past: DataFrame, future: DataFrame, *, targets, id_column, timestamp_column, static) -> Tables:
    return {"past": past, "future": future, "static": None}


def long(past: DataFrame, future: DataFrame, *, targets, id_column, timestamp_column, static) -> Tables:
    return {"past": _long(past, id_column, timestamp_column), "future": _long(future, id_column, timestamp_column), "static": _statics(past, id_column, static)}


def _narrow(df: DataFrame, id_column: str, ordinal: bool) -> DataFrame:
    """Numbers as float, strings (not the id) as category codes."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != id_column]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in KEYS]
    if ordinal:
        df = features.category_codes(df, strings)
    return df.withColumns({c: F.col(c).cast("float") for c in numbers}) if numbers else df


def entries(past: DataFrame, future: DataFrame, *, targets, id_column, timestamp_column, static) -> Tables:
    """Past and prediction rows (past, then future with missing targets) of floats and
    codes; codes are made for past and future apart.

    Also what such a library must be told: ``known`` and ``past_only`` (names of covariates),
    ``future_length`` and ``freq`` (the period's name, None for irregular times), both of the first
    series by id; one small job finds them.
    """
    p = _narrow(_long(past, id_column, timestamp_column), id_column, True)
    f = _narrow(_long(future, id_column, timestamp_column), id_column, True)
    tagged = p.withColumn("is_future", F.lit(False)).unionByName(f.withColumn("is_future", F.lit(True)), allowMissingColumns=True)
    s = _statics(past, id_column, static)
    fixed = {id_column, timestamp_column, *KEYS}
    known = [c for c in f.columns if c not in fixed]
    keys = [id_column, *(k for k in KEYS if k in past.columns)]
    both = past.select(*keys, F.col(timestamp_column).alias("_p")).join(future.select(*keys, F.col(timestamp_column).alias("_f")), keys)
    row = both.orderBy(*keys).select(frequency.name_of(F.concat("_p", "_f")).alias("freq"), F.size("_f").alias("n")).first()
    return {
        "past": p, "future": f, "prediction": tagged, "static": None if s is None else _narrow(s, id_column, True),
        "known": known, "past_only": [c for c in p.columns if c not in fixed | {*known, *targets}], "future_length": row["n"] if row else None, "freq": frequency.period_alias(row["freq"]) if row and row["freq"] else None,
    }


def _univariate(targets: Sequence[str]) -> str:
    if len(targets) != 1:
        raise ValueError("This adapter takes one target; use as_univariate=True for several")
    return targets[0]


def unique_id(past: DataFrame, future: DataFrame, *, targets, id_column, timestamp_column, static) -> Tables:
    target = _univariate(targets)
    names = {id_column: "unique_id", timestamp_column: "ds", target: "y"}
    out = long(past, future, targets=targets, id_column=id_column, timestamp_column=timestamp_column, static=static)
    return {k: None if t is None else t.withColumnsRenamed(names) for k, t in out.items()}


def item_id(past: DataFrame, future: DataFrame, *, targets, id_column, timestamp_column, static) -> Tables:
    """The past's rows carry their series' static columns; these are also a table of their own."""
    target = _univariate(targets)
    names = {id_column: "item_id", timestamp_column: "timestamp", target: "target"}
    out = long(past, future, targets=targets, id_column=id_column, timestamp_column=timestamp_column, static=static)
    if static:  # from the series' own row, without a join
        keep = [k for k in KEYS if k in past.columns]
        out["past"] = nested_to_long(past, id_column, timestamp_column, keep=[*keep, *static], position=None)
    return {k: None if t is None else t.withColumnsRenamed(names) for k, t in out.items()}


def covariates(past: DataFrame, future: DataFrame, *, targets, id_column, timestamp_column, static) -> Tables:
    """Per series: target, past covariates and future covariates (past, then future), numeric only, as float arrays."""
    keep = [k for k in KEYS if k in past.columns]
    numeric = [f.name for f in past.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)) and f.name not in targets]
    known_names = [c for c in numeric if c in future.columns]
    past_names = [c for c in numeric if c not in known_names]
    f = future.select(*keep, id_column, F.col(timestamp_column).alias("_ft"), *(F.col(c).alias(f"_f_{c}") for c in known_names))
    joined = past.join(f, [*keep, id_column])
    floats = lambda c: F.col(c).cast("array<float>")
    series = joined.select(*keep, id_column, timestamp_column, F.concat(F.col(timestamp_column), F.col("_ft")).alias("future_timestamp"), *(floats(t).alias(t) for t in targets), *(floats(c).alias(c) for c in past_names), *(F.concat(floats(c), floats(f"_f_{c}")).alias(c) for c in known_names))
    return {"series": series, "past": past, "future": future, "static": _statics(past, id_column, static)}


ADAPTERS: dict[str, Callable[..., Tables]] = {"datasets": nested, "nested": nested, "pandas": long, "long": long, "entries": entries, "unique_id": unique_id, "item_id": item_id, "covariates": covariates}


def as_univariate(past: DataFrame, future: DataFrame, targets: Sequence[str], id_column: str, timestamp_column: str, target_column: str = "target") -> tuple[DataFrame, DataFrame]:
    """A series for each target, id ``{id}_{target}``; the future's rows are repeated alike."""
    if target_column in past.columns and target_column not in targets:
        raise ValueError(f"Column {target_column!r} exists already; name the single target differently")
    if len(targets) == 1:
        return past.withColumnRenamed(targets[0], target_column), future
    melted = melt_targets(past, targets, id_column, timestamp_column, target_column).drop("target_order")
    names = F.explode(F.array(*(F.lit(t) for t in targets)))
    repeated = future.withColumn("_target", names).withColumn(id_column, F.concat_ws("_", F.col(id_column).cast("string"), "_target")).drop("_target")
    return melted, repeated


def convert(past: DataFrame, future: DataFrame, adapter: str = "long", *, targets: Sequence[str], id_column: str = "id", timestamp_column: str = "timestamp", static: Sequence[str] = (), univariate: bool = False, target_column: str = "target") -> Tables:
    """Tables by name for an adapter (KeyError for an unknown one)."""
    make = ADAPTERS[adapter.lower()]
    if univariate:
        past, future = as_univariate(past, future, targets, id_column, timestamp_column, target_column)
        targets = [target_column]
    return make(past, future, targets=list(targets), id_column=id_column, timestamp_column=timestamp_column, static=list(static))


__all__ = ["ADAPTERS", "as_univariate", "convert", "statics"]

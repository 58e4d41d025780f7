"""Checks of series tables: schema on the driver, everything else in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frequency
from .reshape import column_roles


def schema_problems(df: DataFrame, id_column: str, timestamp_column: str, required: Sequence[str] = ()) -> list[str]:
    have = set(df.columns)
    out = []
    missing = sorted({id_column, timestamp_column, *required} - have)
    if missing:
        return [f"Missing columns: {missing}"]
    if isinstance(df.schema[id_column].dataType, (T.ArrayType, T.MapType, T.StructType)):
        out.append(f"Column {id_column!r} must be a scalar")
    kind = df.schema[timestamp_column].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.TimestampType, T.TimestampNTZType))):
        out.append(f"Column {timestamp_column!r} must be an array of timestamps")
    if not column_roles(df, id_column, timestamp_column)[0]:
        out.append("At least one dynamic column is needed")
    return out


def check(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp", required: Sequence[str] = (), first_rows: int | None = None) -> DataFrame:
    """One row of counts: series, duplicate_ids, irregular, unequal_lengths."""
    dynamic, _ = column_roles(df, id_column, timestamp_column)
    if first_rows is not None:
        df = df.limit(first_rows)
    length = F.size(timestamp_column)
    unequal = F.lit(False)
    for c in dynamic:
        unequal = unequal | (F.size(c) != length)
    marked = frequency.with_regularity(df.select(id_column, timestamp_column, unequal.alias("_unequal")), timestamp_column, "_regular")
    by_id = marked.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_regular")).alias("irregular"), F.count_if(F.col("_unequal")).alias("unequal"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_id.agg(total("n").alias("series"), total(F.col("n") - 1).alias("duplicate_ids"), total("irregular").alias("irregular"), total("unequal").alias("unequal_lengths"))


def validate(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp", required: Sequence[str] = (), first_rows: int | None = None) -> None:
    """Raises ValueError with the first problem found.  Runs one job."""
    problems = schema_problems(df, id_column, timestamp_column, required)
    if problems:
        raise ValueError("; ".join(problems))
    found = check(df, id_column, timestamp_column, required, first_rows).first()
    if found["duplicate_ids"]:
        raise ValueError(f"Ids must be unique: {found['duplicate_ids']} repeated")
    if found["unequal_lengths"]:
        raise ValueError(f"Lengths of entries in dynamic columns differ from the timestamps in {found['unequal_lengths']} series")
    if found["irregular"]:
        raise ValueError(f"{found['irregular']} series have irregular timestamps")


def check_columns(df: DataFrame, dynamic: Sequence[str], static: Sequence[str], id_column: str, timestamp_column: str) -> None:
    have_dynamic, have_static = column_roles(df, id_column, timestamp_column)
    for kind, wanted, have in (("dynamic", dynamic, have_dynamic), ("static", static, have_static)):
        missing = sorted(set(wanted) - set(have))
        if missing:
            raise ValueError(f"Missing {kind} columns: {missing}")

"""Shapes of time-series tables: nested (a row is a series) and long (a row is a step)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept


def column_roles(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp") -> tuple[list[str], list[str]]:
    """(dynamic, static): array columns and the others, without id and timestamp."""
    rest = [f for f in df.schema.fields if f.name not in (id_column, timestamp_column)]
    dynamic = [f.name for f in rest if isinstance(f.dataType, T.ArrayType)]
    return dynamic, [f.name for f in rest if f.name not in dynamic]


def is_long(df: DataFrame, id_column: str, timestamp_column: str) -> bool:
    """Id and timestamp exist and no column is an array."""
    return {id_column, timestamp_column} <= set(df.columns) and not any(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields)


def long_to_nested(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp", static_columns: Sequence[str] = (), string_input: bool = False) -> DataFrame:
    """One row for each id, dynamic columns as arrays in time order.

    A static column's value is the one of the earliest step.  Structs are collected, so
    nulls keep their place.  ``string_input``: ids become strings and timestamps are
    parsed (unparsable ones become null).  One shuffle on the id.
    """
    if string_input:
        df = df.withColumn(id_column, F.col(id_column).cast("string")).withColumn(timestamp_column, F.col(timestamp_column).try_cast("timestamp_ntz"))
    kind = df.schema[timestamp_column].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise ValueError(f"Column {timestamp_column!r} must have a timestamp type, got {kind.simpleString()}")
    dynamic = [c for c in df.columns if c not in (id_column, timestamp_column, *static_columns)]
    steps = F.array_sort(F.collect_list(F.struct(F.col(timestamp_column).cast("timestamp_ntz").alias("_t"), *(F.col(f"`{c}`") for c in dynamic))), lambda a, b: F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).otherwise(0))
    grouped = df.groupBy(id_column).agg(steps.alias("_steps"), *(F.min_by(F.struct(F.col(c)), F.col(timestamp_column)).alias(c) for c in static_columns))
    return grouped.select(id_column, F.col("_steps._t").alias(timestamp_column), *(F.col("_steps").getField(c).alias(c) for c in dynamic), *(F.col(c).getField(c).alias(c) for c in static_columns))


def nested_to_long(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp", keep: Sequence[str] = (), position: str | None = "pos") -> DataFrame:
    """One row for each step; static columns go, but for those in ``keep``."""
    dynamic, _ = column_roles(df, id_column, timestamp_column)
    arrays = [c for c in [timestamp_column, *dynamic] if c in df.columns]
    zipped = F.arrays_zip(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(arrays)))
    exploded = df.select(id_column, *keep, F.posexplode(zipped).alias("_pos", "_step"))
    return exploded.select(id_column, *keep, *([F.col("_pos").alias(position)] if position else []), *(F.col("_step")[f"_{i}"].alias(c) for i, c in enumerate(arrays)))


def statics(df: DataFrame, id_column: str, static_columns: Sequence[str]) -> DataFrame:
    """Ids as strings with their static columns."""
    return df.select(F.col(id_column).cast("string").alias(id_column), *static_columns)


def melt_targets(df: DataFrame, targets: Sequence[str] | str, id_column: str = "id", timestamp_column: str = "timestamp", target_column: str = "target") -> DataFrame:
    """A row for each series and target, id ``{id}_{target}``; other columns are repeated.

    ``"__ALL__"`` takes every array column but the timestamp.  No shuffle.
    """
    if isinstance(targets, str):
        targets = column_roles(df, id_column, timestamp_column)[0] if targets == "__ALL__" else [targets]
    missing = sorted(set(targets) - set(df.columns))
    if missing:
        raise ValueError(f"Missing target columns: {missing}")
    if target_column in df.columns and target_column not in targets:
        raise ValueError(f"Column {target_column!r} exists already")
    others = [c for c in df.columns if c not in (id_column, *targets)]
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("array<double>").alias("values")) for c in targets))
    exploded = df.select(id_column, *others, F.posexplode(each).alias("_order", "_t"))
    return exploded.select(F.concat_ws("_", F.col(id_column).cast("string"), F.col("_t.name")).alias(id_column), *others, F.col("_t.values").alias(target_column), F.col("_order").alias("target_order"))


def ordered(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Ids as strings, with ``item_ord``: the rank by id from 0 (byte order).

    Uses a range sort and counts of its partitions, not one window over all rows.  The sorted
    rows are written to the shared folder, so this runs a job.
    """
    df = df.withColumn(id_column, F.col(id_column).cast("string"))
    parts = df.repartitionByRange(id_column).sortWithinPartitions(id_column).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranked = kept(parts, "ordered")  # ranges and rows have to be those that were counted
    sizes = ranked.groupBy("_part").count()
    offsets = sizes.withColumn("_from", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_from")  # a row for each partition
    return ranked.join(F.broadcast(offsets), "_part").withColumn("item_ord", F.col("_row") + F.col("_from")).drop("_part", "_row", "_from")


def melt_long(df: DataFrame, targets: Sequence[str], name: str = "target_name", value: str = "value") -> DataFrame:
    """Long rows: one for each step and target."""
    return df.unpivot([c for c in df.columns if c not in targets], list(targets), name, value)


def combine_univariate(predictions: DataFrame, targets: Sequence[str], item_ord: str = "item_ord") -> DataFrame:
    """Predictions of melted items back to (item, target): row i*D + d is item i, target d.

    The number of rows must be a multiple of the number of targets (checked when run).
    """
    d = len(targets)
    names = F.array(*(F.lit(t) for t in targets))
    out = predictions.withColumn("target_name", F.get(names, (F.col(item_ord) % d).cast("int"))).withColumn(item_ord, F.expr(f"{item_ord} div {d}"))
    total = predictions.agg((F.count(F.lit(1)) % d).alias("_left"))
    checked = total.select(F.when(F.col("_left") != 0, F.raise_error(F.lit(f"The number of predictions must be divisible by {d}"))).otherwise(F.lit(True)).alias("_fits"))
    return out.join(F.broadcast(checked), F.col("_fits").isNull() | F.col("_fits")).drop("_fits")  # one row


def flat_to_nested(flat: DataFrame, horizon: int, targets: Sequence[str], position: str = "pos", values: Sequence[str] = ("predictions",)) -> DataFrame:
    """A flat forecast (position, values) as arrays by item and target."""
    d = len(targets)
    numbered = flat.withColumn("_item", F.expr(f"{position} div {horizon}")).withColumn("_step", F.col(position) % horizon)
    lists = numbered.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("_step", *values))).alias("_s"))  # horizon rows of a group
    names = F.array(*(F.lit(t) for t in targets))
    return lists.select(F.expr(f"_item div {d}").alias("item_ord"), F.get(names, (F.col("_item") % d).cast("int")).alias("target_name"), *(F.col("_s").getField(v).alias(v) for v in values))


#: Moduli of the two sums of a content digest (the largest primes below 2**61 and 2**59).
MODULI = (2**61 - 1, 2**59 - 55)


def content_sums(df: DataFrame) -> DataFrame:
    """One row: n (rows), a and b, two sums of 60-bit hashes of all rows' whole contents.

    A multiset hash: any changed, missing or further row changes it; the order of rows and how they
    are partitioned do not.  Sums of parts can be added.  One aggregate without a sort.
    """
    text = F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
    part = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(20,0)")
    sums = [(F.coalesce(F.sum(part(at)), F.lit(0)).cast("decimal(38,0)") % F.lit(m).cast("decimal(38,0)")).cast("long").alias(name) for at, m, name in ((1, MODULI[0], "a"), (17, MODULI[1], "b"))]
    return df.select(text.alias("_h")).agg(F.count(F.lit(1)).alias("n"), *sums)


def fingerprint(df: DataFrame, id_column: str = "id") -> str | None:
    """A digest of the schema and the whole content, whatever the order of rows.

    Stable for equal data however they are partitioned; None if it can't be taken.
    """
    try:
        row = content_sums(df).first()
        return hashlib.sha256(f"{df.schema.json()}|{row['n']}|{row['a']}|{row['b']}".encode()).hexdigest()[:16]
    except Exception as e:  # a digest is never worth a failed run
        import warnings

        warnings.warn(f"No fingerprint: {e}", stacklevel=2)
        return None

"""Series too long for one row: segments of equal size, and evaluation windows over them.

A segment is a row (id, block, start, n, arrays): the steps with positions from
``block * size`` on.  Positions come from a prefix count over time buckets, so no task ever
holds or sorts a whole series:

* ``positions``: rows of each (id, time bucket) are counted with a map-side sum; the running
  sum over a series' buckets (a few numbers for each) gives each bucket its offset; within
  its bucket a step has its rank.
* ``build``: steps with the same ``position div size`` become one segment.
* A window is a pair of position ranges.  Cutting it reads the segments that overlap it.
* A seasonal lag that leaves a segment is found in a piece that the earlier segment sends to
  the one or two segments its steps are compared with: an equi-join on (id, block) that
  moves ``min(season, size)`` values of each segment, whatever the season.

Hence one series of any length is spread over all tasks, and a row has at most ``size`` steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.numeric import known

#: Steps of a segment, and of a time bucket (about).
SIZE = 4096


def bucket_width(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp", steps: int = SIZE) -> int:
    """Microseconds in which the densest series (on average) has ``steps`` steps."""
    at = F.unix_micros(F.col(timestamp_column).cast("timestamp"))
    each = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    step = each.filter("n > 1 and span > 0").agg(F.min(F.col("span") / (F.col("n") - 1)).alias("step")).first()["step"]
    return max(1, int((step or 1) * steps))


def positions(df: DataFrame, id_column: str = "id", timestamp_column: str = "timestamp", width: int | None = None) -> DataFrame:
    """``df`` (one row for each id and timestamp) with ``pos`` (from 0) and ``length`` of its series.

    ``width``: microseconds of a time bucket (default: ``bucket_width``).  A bucket with more steps
    than others is only a larger sort.
    """
    width = width or bucket_width(df, id_column, timestamp_column)
    bucket = F.floor(F.unix_micros(F.col(timestamp_column).cast("timestamp")) / F.lit(width)).cast("long")
    steps = df.withColumn("_bucket", bucket)
    counts = steps.groupBy(id_column, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_id = Window.partitionBy(id_column)
    offsets = counts.select(
        id_column, "_bucket",
        (F.sum("_n").over(by_id.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"), F.sum("_n").over(by_id).alias("length"),
    )
    rank = F.row_number().over(Window.partitionBy(id_column, "_bucket").orderBy(timestamp_column)) - 1
    return steps.join(offsets, [id_column, "_bucket"]).withColumn("pos", F.col("_before") + rank).drop("_bucket", "_before")


def build(df: DataFrame, columns: Sequence[str], id_column: str = "id", timestamp_column: str = "timestamp", size: int = SIZE, width: int | None = None) -> DataFrame:
    """id, block, start, n, length and an array of each of the columns and of the timestamp.

    Other columns are left out.  Rows with a null id or timestamp are refused by
    ``validate``; here they would be a series or a first step of their own.
    """
    own = [timestamp_column, *columns]
    placed = positions(df.select(id_column, *own), id_column, timestamp_column, width)
    steps = F.array_sort(F.collect_list(F.struct("pos", *(F.col(f"`{c}`") for c in own))), lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    grouped = placed.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy(id_column, "block").agg(F.first("length").alias("length"), steps.alias("_s"))
    return grouped.select(id_column, "block", (F.col("block") * size).alias("start"), F.size("_s").alias("n"), "length", *(F.col("_s").getField(c).alias(c) for c in own))


def cuts(segments: DataFrame, cutoffs: Sequence[int] | Sequence[datetime], horizon: int, id_column: str = "id", timestamp_column: str = "timestamp", min_context: int = 1) -> DataFrame:
    """window_idx, cutoff, id, cut (past steps), length of the kept windows of each series.

    A series' numbers come from its segments by one aggregate: its length, and for timestamp
    cutoffs the steps up to each.
    """
    whole = all(isinstance(c, int) for c in cutoffs)
    if whole:
        each = segments.groupBy(id_column).agg(F.first("length").alias("length"))
        at = [series.cutoff_index(F.col("length"), F.lit(c)) for c in cutoffs]
    else:
        up_to = [F.sum(series.cutoff_index_at(timestamp_column, F.lit(c).cast("timestamp_ntz")).cast("long")).alias(f"_c{i}") for i, c in enumerate(cutoffs)]
        each = segments.groupBy(id_column).agg(F.first("length").alias("length"), *up_to)
        at = [F.col(f"_c{i}") for i in range(len(cutoffs))]
    windows = F.array(*(F.struct(F.lit(i).alias("window_idx"), (F.lit(c) if whole else F.lit(c).cast("timestamp_ntz")).alias("cutoff"), a.cast("long").alias("cut")) for i, (c, a) in enumerate(zip(cutoffs, at))))
    return each.select(id_column, "length", F.inline(windows)).filter((F.col("cut") >= min_context) & (F.col("length") - F.col("cut") >= horizon))


def ranges(segments: DataFrame, kept: DataFrame, low: Column, high: Column, columns: Sequence[str], size: int = SIZE, id_column: str = "id") -> DataFrame:
    """The steps with positions in [``low``, ``high``) of each window: window_idx, id, first
    (position) and the columns' slices.  A window asks for its segments by (id, block), so a
    long series is no hot key."""
    asked = kept.select(id_column, "window_idx", low.cast("long").alias("_low"), high.cast("long").alias("_high")).filter("_low < _high")
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("_low") / size).cast("long"), F.floor((F.col("_high") - 1) / size).cast("long"))))
    met = segments.join(asked, [id_column, "block"])
    first = F.greatest(F.col("start"), F.col("_low"))
    n = F.least(F.col("start") + F.col("n"), F.col("_high")) - first
    return met.filter(n > 0).select("window_idx", id_column, first.alias("first"), *(F.slice(F.col(f"`{c}`"), (first - F.col("start") + 1).cast("int"), n.cast("int")).alias(c) for c in columns))


def past(segments: DataFrame, kept: DataFrame, columns: Sequence[str], size: int = SIZE, id_column: str = "id", max_context: int | None = None) -> DataFrame:
    """What a model may see, still in segments."""
    low = F.lit(0) if max_context is None else F.greatest(F.lit(0), F.col("cut") - max_context)
    return ranges(segments, kept, low, F.col("cut"), columns, size, id_column)


def future(segments: DataFrame, kept: DataFrame, horizon: int, columns: Sequence[str], size: int = SIZE, id_column: str = "id") -> DataFrame:
    """The ``horizon`` steps after each cutoff, in segments."""
    return ranges(segments, kept, F.col("cut"), F.col("cut") + horizon, columns, size, id_column)


def joined(parts: DataFrame, columns: Sequence[str], id_column: str = "id") -> DataFrame:
    """A row for each window and series with whole arrays: for ranges of bounded length."""
    pieces = F.array_sort(F.collect_list(F.struct("first", *(F.col(f"`{c}`") for c in columns))), lambda a, b: F.when(a["first"] < b["first"], -1).otherwise(1))
    rows = parts.groupBy("window_idx", id_column).agg(pieces.alias("_p"))
    return rows.select("window_idx", id_column, *(F.flatten(F.col("_p").getField(c)).alias(c) for c in columns))


def windows(segments: DataFrame, kept: DataFrame, horizon: int, context: int, columns: Sequence[str] = ("target",), size: int = SIZE, id_column: str = "id", timestamp_column: str = "timestamp") -> DataFrame:
    """Rows in the form of ``operators.windows.split``, the past being its last ``context`` steps:
    what forecasts of bounded context and all metrics take."""
    own = [timestamp_column, *columns]
    before = joined(past(segments, kept, own, size, id_column, context), own, id_column)
    after = joined(future(segments, kept, horizon, own, size, id_column), own, id_column)
    as_struct = lambda df, name: df.select("window_idx", id_column, F.struct(*(F.col(f"`{c}`") for c in own)).alias(name))
    return kept.join(as_struct(before, "past"), ["window_idx", id_column]).join(as_struct(after, "future"), ["window_idx", id_column])


def lagged(segments: DataFrame, column: str, lag: int, size: int = SIZE, id_column: str = "id") -> DataFrame:
    """Segments with ``_x`` (the column as doubles) and ``_lag``: the values ``lag`` steps before."""
    values = segments.select(id_column, "block", "start", "n", F.transform(F.col(f"`{column}`"), lambda x: known(x)).alias("_x"))
    far, rest = divmod(lag, size)
    inner = size - rest  # so many first steps of a segment have their counterpart in segment + far, the others in the next
    one = values.select(id_column, (F.col("block") + far).alias("block"), F.lit(rest).alias("_at"), F.slice("_x", 1, inner).alias("_v"))
    two = values.filter(F.lit(rest > 0) & (F.col("n") > inner)).select(id_column, (F.col("block") + far + 1).alias("block"), F.lit(0).alias("_at"), F.slice("_x", inner + 1, rest).alias("_v")) if rest else None
    own = values
    if far == 0:  # what stays in its own segment needs no join
        local = F.concat(F.array_repeat(F.lit(None).cast("double"), rest), F.slice("_x", 1, inner))
        if two is None:
            return own.withColumn("_lag", F.col("_x"))
        out = own.join(two.select(id_column, "block", "_v"), [id_column, "block"], "left")
        head = F.coalesce(F.col("_v"), F.array().cast("array<double>"))
        whole = F.concat(head, F.slice(local, F.size(head) + 1, F.lit(size)))
    else:
        pieces = one if two is None else one.union(two)
        got = pieces.groupBy(id_column, "block").agg(F.max(F.when(F.col("_at") == rest, F.col("_v"))).alias("_a"), *([] if two is None else [F.max(F.when(F.col("_at") == 0, F.col("_v"))).alias("_b")]))
        out = own.join(got, [id_column, "block"], "left")
        head = F.array_repeat(F.lit(None).cast("double"), rest) if two is None else F.coalesce(F.col("_b"), F.array_repeat(F.lit(None).cast("double"), rest))
        whole = F.concat(head, F.coalesce(F.col("_a"), F.array().cast("array<double>")))
    fitted = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(whole, i))
    return out.select(id_column, "block", "start", "n", "_x", fitted.alias("_lag"))


def seasonal_errors(segments: DataFrame, kept: DataFrame, column: str, season: int, size: int = SIZE, id_column: str = "id", max_context: int | None = None) -> DataFrame:
    """window_idx, id, scale_abs, scale_sq: the mean absolute and squared seasonal difference of
    each window's past (null without a known pair), from sums over its segments."""
    pairs = lagged(segments, column, season, size, id_column)
    differences = pairs.select(id_column, "block", "start", "n", F.zip_with("_x", "_lag", lambda a, b: a - b).alias("_d"))
    low = F.lit(0) if max_context is None else F.greatest(F.lit(0), F.col("cut") - max_context)
    parts = ranges(differences, kept, low + season, F.col("cut"), ["_d"], size, id_column)
    found = F.filter("_d", lambda d: d.isNotNull())
    add = lambda f: F.aggregate(found, F.lit(0.0), lambda s, d: s + f(d))
    sums = parts.select("window_idx", id_column, F.size(found).cast("long").alias("_n"), add(F.abs).alias("_a"), add(lambda d: d * d).alias("_q"))
    totals = sums.groupBy("window_idx", id_column).agg(F.sum("_n").alias("_n"), F.sum("_a").alias("_a"), F.sum("_q").alias("_q"))
    return kept.select("window_idx", id_column).join(totals, ["window_idx", id_column], "left").select("window_idx", id_column, F.try_divide("_a", F.nullif("_n", F.lit(0))).alias("scale_abs"), F.try_divide("_q", F.nullif("_n", F.lit(0))).alias("scale_sq"))

"""Queries over the star-schema tables, one for each operator, with the same in SQL.

Base series: daily events by type, monthly shipments by flag and status, monthly orders
by priority.  Results are flat and rounded alike on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import frequency, numeric, series
from .operators import adapters, analytics, autoregression, baselines, features, metrics, predictions, reshape, segments, smoothing, validate, windows
from .sources import datasets
from .sources.shared import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEVELS = (0.1, 0.5, 0.9)
H, S = 7, 7
CUTS = (-14, -7)


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r(x: Column | str, places: int = 6) -> Column:
    return F.round(numeric.col(x), places)


def period(unit: str, c: str) -> Column:
    return F.date_trunc(unit, F.col(c)).cast("timestamp_ntz")


# -- base series ----------------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long: id, timestamp, target, users (targets), n_events (known), mean_value (past)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("id"), period("day", "ts").alias("timestamp")).agg(F.sum("value").alias("target"), F.count_distinct("user_id").cast("double").alias("users"), F.count(F.lit(1)).cast("double").alias("n_events"), F.avg("value").alias("mean_value"))


def monthly_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("id"), period("month", "l_shipdate").alias("timestamp")).agg(F.sum("l_quantity").alias("target"), F.count(F.lit(1)).cast("double").alias("n_items"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.groupBy(F.col("o_orderpriority").alias("id"), period("month", "o_orderdate").alias("timestamp")).agg(F.count(F.lit(1)).cast("double").alias("target"))


def nested(df: DataFrame) -> DataFrame:
    return reshape.long_to_nested(df)


DAILY = "daily AS (SELECT event_type AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp, sum(value) AS target, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, CAST(count(*) AS DOUBLE) AS n_events, avg(value) AS mean_value FROM events GROUP BY 1, 2)"
SHIP = "ship AS (SELECT l_returnflag || '_' || l_linestatus AS id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS timestamp, sum(l_quantity) AS target, CAST(count(*) AS DOUBLE) AS n_items FROM lineitem GROUP BY 1, 2)"
ORDERS = "ord AS (SELECT o_orderpriority AS id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS timestamp, CAST(count(*) AS DOUBLE) AS target FROM orders GROUP BY 1, 2)"


def positions(base: str) -> str:
    return f"pos AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) - 1 AS pos, count(*) OVER (PARTITION BY id) AS len FROM {base})"


def cutting(cuts=CUTS, h: int = H, min_context: int = 1, max_context: int | None = None) -> str:
    """CTEs: win, kept (rows of kept series with idx), past, fut."""
    rows = ", ".join(f"({i}, {c if isinstance(c, int) else repr(c)})" for i, c in enumerate(cuts))
    if isinstance(cuts[0], int):
        idx = "SELECT window_idx, p.*, greatest(0, least(len, CASE WHEN cutoff >= 0 THEN cutoff ELSE len + cutoff END)) AS idx FROM pos p, win"
    else:
        idx = "SELECT window_idx, p.*, sum(CASE WHEN timestamp <= CAST(cutoff AS TIMESTAMP) THEN 1 ELSE 0 END) OVER (PARTITION BY window_idx, id) AS idx FROM pos p, win"
    low = "0" if max_context is None else f"greatest(0, idx - {max_context})"
    return f"win(window_idx, cutoff) AS (VALUES {rows}), cut AS ({idx}), kept AS (SELECT * FROM cut WHERE idx >= {min_context} AND len - idx >= {h}), past AS (SELECT * FROM kept WHERE pos < idx AND pos >= {low}), fut AS (SELECT *, pos - idx AS step FROM kept WHERE pos >= idx AND pos < idx + {h})"


# -- ingest -----------------------------------------------------------------------------------


@query(f"WITH {DAILY}, {positions('daily')} SELECT id, pos, strftime(timestamp, '%Y-%m-%d') AS day, round(target, 6) AS target, n_events FROM pos")
def long_to_nested(spark, sf_dir):
    steps = reshape.nested_to_long(nested(daily(spark, sf_dir)))
    return steps.select("id", F.col("pos").cast("long").alias("pos"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"), r("target").alias("target"), "n_events")


@query(f"WITH {SHIP} SELECT id, strftime(timestamp, '%Y-%m') AS month, target, n_items FROM ship")
def nested_to_long(spark, sf_dir):
    steps = reshape.nested_to_long(nested(monthly_ship(spark, sf_dir)), position=None)
    return steps.select("id", F.date_format("timestamp", "yyyy-MM").alias("month"), "target", "n_items")


@query(f"WITH {SHIP} SELECT id, substr(id, 1, 1) AS flag, min(strftime(timestamp, '%Y-%m')) AS first_month FROM ship GROUP BY 1, 2")
def static_features(spark, sf_dir):
    df = monthly_ship(spark, sf_dir).withColumn("flag", F.substring("id", 1, 1)).withColumn("first_month", F.date_format("timestamp", "yyyy-MM"))
    return reshape.statics(reshape.long_to_nested(df, static_columns=["flag", "first_month"]), "id", ["flag", "first_month"])


MELT = "melted AS (SELECT id || '_target' AS id, timestamp, n_events, target AS value FROM daily UNION ALL SELECT id || '_users', timestamp, n_events, users FROM daily)"


@query(f"WITH {DAILY}, {MELT} SELECT id, strftime(timestamp, '%Y-%m-%d') AS day, n_events, round(value, 6) AS value FROM melted")
def melt_targets(spark, sf_dir):
    melted = reshape.melt_targets(nested(daily(spark, sf_dir)).drop("mean_value"), ["target", "users"], target_column="value").drop("target_order")
    steps = reshape.nested_to_long(melted)
    return steps.select("id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "n_events", r("value").alias("value"))


@query(f"WITH {DAILY}, all_cols AS (UNPIVOT (SELECT id, timestamp, target, users, n_events, mean_value FROM daily) ON target, users, n_events, mean_value INTO NAME c VALUE v) SELECT id || '_' || c AS id, count(*) AS steps, round(sum(v), 4) AS total FROM all_cols GROUP BY 1")
def melt_all(spark, sf_dir):
    steps = reshape.nested_to_long(reshape.melt_targets(nested(daily(spark, sf_dir)), "__ALL__", target_column="v").drop("target_order"))
    return steps.groupBy("id").agg(F.count(F.lit(1)).alias("steps"), r(F.sum("v"), 4).alias("total"))


@query(f"WITH {DAILY}, {MELT} SELECT id, row_number() OVER (ORDER BY id) - 1 AS item_ord FROM (SELECT DISTINCT id FROM melted)")
def item_order(spark, sf_dir):
    melted = reshape.melt_targets(nested(daily(spark, sf_dir)), ["target", "users"], target_column="value")
    return reshape.ordered(melted).select("id", F.col("item_ord").cast("long").alias("item_ord"))


@query(f"WITH {ORDERS}, per AS (SELECT id, count(*) AS n, count(DISTINCT year(timestamp) * 12 + month(timestamp)) AS m, max(year(timestamp) * 12 + month(timestamp)) - min(year(timestamp) * 12 + month(timestamp)) + 1 AS span FROM ord GROUP BY 1) SELECT id, n AS steps, n >= 3 AND n = span AS regular FROM per")
def freq_regular_flags(spark, sf_dir):
    return frequency.with_regularity(nested(monthly_orders(spark, sf_dir)), "timestamp").select("id", F.size("timestamp").cast("long").alias("steps"), "regular")


KINDS = "kinds AS (SELECT DISTINCT 'month' AS kind, o_orderpriority AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders UNION ALL SELECT DISTINCT 'quarter', o_orderpriority, CAST(date_trunc('quarter', o_orderdate) AS DATE) FROM orders UNION ALL SELECT DISTINCT 'week', event_type, CAST(date_trunc('week', ts) AS DATE) FROM events UNION ALL SELECT DISTINCT 'weekday', event_type, CAST(ts AS DATE) FROM events WHERE isodow(ts) <= 5 UNION ALL SELECT DISTINCT 'day', event_type, CAST(ts AS DATE) FROM events)"
KIND_GAPS = "gaps AS (SELECT kind, id, d, d - lag(d) OVER w AS g, (year(d) * 12 + month(d)) - (year(lag(d) OVER w) * 12 + month(lag(d) OVER w)) AS m, isodow(d) AS wd FROM kinds WINDOW w AS (PARTITION BY kind, id ORDER BY d)), facts AS (SELECT kind, id, count(*) AS n, min(g) AS g0, max(g) AS g1, min(m) AS m0, max(m) AS m1, bool_and(g IS NULL OR (wd = 1 AND g = 3) OR (wd BETWEEN 2 AND 5 AND g = 1)) AS business FROM gaps GROUP BY 1, 2)"


@query(f"WITH {KINDS}, {KIND_GAPS} SELECT kind, id, CASE WHEN n < 3 THEN NULL WHEN kind = 'month' AND m0 = 1 AND m1 = 1 THEN 'MS' WHEN kind = 'quarter' AND m0 = 3 AND m1 = 3 THEN 'QS-OCT' WHEN kind = 'week' AND g0 = 7 AND g1 = 7 THEN 'W-MON' WHEN kind = 'weekday' AND business AND g0 = 1 AND g1 = 3 THEN 'B' WHEN kind = 'day' AND g0 = 1 AND g1 = 1 THEN 'D' END AS freq FROM facts")
def freq_names(spark, sf_dir):
    """Names of frequencies by expressions: months, quarters, weeks, business days, days."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    kinds = [("month", o, "o_orderpriority", period("month", "o_orderdate")), ("quarter", o, "o_orderpriority", period("quarter", "o_orderdate")), ("week", e, "event_type", period("week", "ts")), ("weekday", e.filter(F.weekday("ts") < 5), "event_type", period("day", "ts")), ("day", e, "event_type", period("day", "ts"))]
    each = None
    for kind, df, key, at in kinds:
        one = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), at.alias("t"))
        each = one if each is None else each.unionByName(one)
    return each.groupBy("kind", "id").agg(F.sort_array(F.collect_set("t")).alias("t")).select("kind", "id", frequency.name_of("t").alias("freq"))


@query(f"WITH {DAILY} SELECT count(DISTINCT id) AS series, CAST(0 AS BIGINT) AS duplicate_ids, CAST(0 AS BIGINT) AS irregular, CAST(0 AS BIGINT) AS unequal_lengths FROM daily")
def validate_series(spark, sf_dir):
    return validate.check(nested(daily(spark, sf_dir)))


@query("WITH u AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events GROUP BY 1, 2), per AS (SELECT id, count(*) AS n, date_diff('day', min(d), max(d)) + 1 AS span FROM u GROUP BY 1), gaps AS (SELECT id, min(g) AS lo, max(g) AS hi, count(g) AS k FROM (SELECT id, date_diff('day', lag(d) OVER (PARTITION BY id ORDER BY d), d) AS g FROM u) GROUP BY 1) SELECT count(*) AS series, CAST(sum(CASE WHEN k >= 2 AND lo = hi THEN 0 ELSE 1 END) AS BIGINT) AS constant_step_missing FROM gaps")
def irregular_users(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("id"), period("day", "ts").alias("timestamp")).agg(F.sum("value").alias("target"))
    n = nested(e).withColumn("delta", frequency.regular_delta("timestamp"))
    return n.agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("delta").isNull() | (F.size("timestamp") < 3)).alias("constant_step_missing"))


@query(f"WITH rows AS (SELECT md5(to_json({{o_orderkey: o_orderkey, o_custkey: o_custkey, o_orderstatus: o_orderstatus, o_orderpriority: o_orderpriority}})) AS h, o_orderpriority AS part FROM orders) SELECT part, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) % {2**61 - 1} AS BIGINT) AS a, CAST(sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) % {2**59 - 55} AS BIGINT) AS b FROM rows GROUP BY 1")
def content_digests(spark, sf_dir):
    """The multiset hash of each part of a table."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    parts = [row[0] for row in o.select("o_orderpriority").distinct().collect()]  # a few priorities
    each = None
    for part in parts:
        one = reshape.content_sums(o.filter(F.col("o_orderpriority") == part)).withColumn("part", F.lit(part))
        each = one if each is None else each.unionByName(one)
    return each.select("part", "n", "a", "b")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 5000 AND c_nationkey IN (1, 2, 3) GROUP BY 1")
def arrow_round_trip(spark, sf_dir):
    """A table written as Arrow files and read with pruned batches and columns."""
    from .sources import arrow_files, shared

    path = f"{shared.folder(spark).removeprefix('file://')}/customers-{uuid.uuid4().hex}.arrow"
    datasets.save(table(spark, sf_dir, "customer").repartitionByRange(4, "c_acctbal"), path, "append")
    some = arrow_files.read(spark, path, ["c_mktsegment", "c_acctbal", "c_nationkey"], [("c_acctbal", ">", 5000.0), ("c_nationkey", "in", [1, 2, 3])])
    return some.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("total"))


# -- windows ------------------------------------------------------------------------------------


def flat_part(w: DataFrame, part: str, column: str = "target") -> DataFrame:
    out = w.select("window_idx", "id", F.posexplode(F.arrays_zip(F.col(part).getField("timestamp").alias("t"), F.col(part).getField(column).alias("v"))).alias("step", "_v"))
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.col("step").cast("long").alias("step"), F.date_format(F.col("_v.t"), "yyyy-MM-dd").alias("day"), r("_v.v").alias("value"))


def part_sql(base: str, name: str, part: str, cut: str, column: str = "target") -> str:
    step = "step" if part == "fut" else "row_number() OVER (PARTITION BY window_idx, id ORDER BY pos) - 1"
    return f"WITH {base}, {positions(name)}, {cut} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST({step} AS BIGINT) AS step, strftime(timestamp, '%Y-%m-%d') AS day, round({column}, 6) AS value FROM {part}"


def split_query(name, source, base_sql, base_name, cuts, h, part, column="target", **options):
    def f(spark, sf_dir):
        df = nested(source(spark, sf_dir))
        dynamic = [c for c in df.columns if c not in ("id", "timestamp")]
        return flat_part(windows.split(df, cuts, h, dynamic=dynamic, **options), part, column)

    sql_cuts = [c if isinstance(c, int) else str(c) for c in cuts]
    query(part_sql(base_sql, base_name, "fut" if part == "future" else "past", cutting(sql_cuts, h, **options), column), name)(f)


def _at(text: str):
    import datetime

    return datetime.datetime.fromisoformat(text)


split_query("cutoff_int_negative", daily, DAILY, "daily", (-7,), 7, "future")
split_query("cutoff_int_positive", daily, DAILY, "daily", (20,), 5, "future")
split_query("cutoff_timestamp", monthly_orders, ORDERS, "ord", (_at("1996-03-15"),), 6, "future")
split_query("past_split", daily, DAILY, "daily", (-7,), 7, "past")
split_query("ground_truth", monthly_ship, SHIP, "ship", (-12,), 12, "future")
split_query("max_context", monthly_ship, SHIP, "ship", (-12,), 12, "past", max_context=10)
split_query("rolling_windows", monthly_ship, SHIP, "ship", (-36, -24, -12), 12, "future")
split_query("overlapping_windows", monthly_ship, SHIP, "ship", (-20, -16, -12), 12, "future")
split_query("length_filter", monthly_orders, ORDERS, "ord", (70,), 10, "past", min_context=60)
split_query("future_known", daily, DAILY, "daily", CUTS, H, "future", "n_events")


@query(f"WITH {ORDERS}, {positions('ord')}, {cutting((60, 70, 75), 5)}, k AS (SELECT window_idx, count(DISTINCT id) AS kept FROM kept GROUP BY 1) SELECT CAST(w.window_idx AS INT) AS window_idx, coalesce(kept, 0) AS kept, (SELECT count(DISTINCT id) FROM ord) - coalesce(kept, 0) AS dropped FROM win w LEFT JOIN k ON w.window_idx = k.window_idx")
def dropped_series(spark, sf_dir):
    df = nested(monthly_orders(spark, sf_dir))
    return windows.dropped(df, windows.split(df, (60, 70, 75), 5), 3)


# -- long series in segments ------------------------------------------------------------------------

SIZE, LONG_CUTS = 256, (-21, -14, -7)
SHIPDAY = "shipday AS (SELECT l_returnflag || '_' || l_linestatus AS id, CAST(l_shipdate AS TIMESTAMP) AS timestamp, sum(l_quantity) AS target, CAST(count(*) AS DOUBLE) AS n_items FROM lineitem GROUP BY 1, 2)"


def daily_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments by day, flag and status, some thousand steps each, in segments of SIZE."""
    t = table(spark, sf_dir, "lineitem")
    days = t.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("id"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp")).agg(F.sum("l_quantity").alias("target"), F.count(F.lit(1)).cast("double").alias("n_items"))
    return kept(segments.build(days, ["target", "n_items"], size=SIZE), "segments")


def long_steps(parts: DataFrame, cut: DataFrame) -> DataFrame:
    out = parts.join(cut.select("window_idx", "id", "cut"), ["window_idx", "id"]).select("window_idx", "id", (F.col("first") - F.col("cut")).alias("_at"), F.posexplode(F.arrays_zip("timestamp", "target")).alias("_k", "_v"))
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "id", (F.col("_at") + F.col("_k")).cast("long").alias("step"), F.date_format("_v.timestamp", "yyyy-MM-dd").alias("day"), r("_v.target").alias("value"))


@query(part_sql(SHIPDAY, "shipday", "fut", cutting(LONG_CUTS)))
def long_windows(spark, sf_dir):
    """The same rows as windows over whole arrays give."""
    s = daily_segments(spark, sf_dir)
    cut = segments.cuts(s, LONG_CUTS, H)
    return long_steps(segments.future(s, cut, H, ["timestamp", "target"], SIZE), cut)


@query(part_sql(SHIPDAY, "shipday", "fut", cutting(("1995-05-10", "1998-01-01"), H)))
def long_cutoff_times(spark, sf_dir):
    s = daily_segments(spark, sf_dir)
    cut = segments.cuts(s, (_at("1995-05-10"), _at("1998-01-01")), H)
    return long_steps(segments.future(s, cut, H, ["timestamp", "target"], SIZE), cut)


@query(f"WITH {SHIPDAY}, {positions('shipday')}, {cutting(LONG_CUTS, max_context=1000)} SELECT CAST(window_idx AS INT) AS window_idx, id, count(*) AS steps, min(strftime(timestamp, '%Y-%m-%d')) AS first_day, max(strftime(timestamp, '%Y-%m-%d')) AS last_day, round(sum(target), 4) AS total FROM past GROUP BY 1, 2")
def long_past(spark, sf_dir):
    s = daily_segments(spark, sf_dir)
    parts = segments.past(s, segments.cuts(s, LONG_CUTS, H), ["timestamp", "target"], SIZE, max_context=1000)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    sums = parts.groupBy(F.col("window_idx").cast("int").alias("window_idx"), "id").agg(F.sum(F.size("target")).alias("steps"), day(F.min(F.get("timestamp", F.lit(0)))).alias("first_day"), day(F.max(F.element_at("timestamp", -1))).alias("last_day"), F.sum(F.aggregate("target", F.lit(0.0), lambda a, b: a + b)).alias("total"))
    return sums.withColumn("total", r("total", 4))


# -- baselines ------------------------------------------------------------------------------------

HIST = "hist AS (SELECT window_idx, id, idx, list(target ORDER BY pos) AS y FROM past GROUP BY 1, 2, 3), steps AS (SELECT hist.*, s.step FROM hist, (SELECT unnest(generate_series(0, 6)) AS step) s)"
POINTS = {
    "naive": "y[len(y)]",
    "seasonal_naive": f"CASE WHEN len(y) >= {S} THEN y[len(y) - {S} + step % {S} + 1] ELSE y[len(y)] END",
    "drift": "y[len(y)] + (step + 1) * CASE WHEN len(y) > 1 THEN (y[len(y)] - y[1]) / (len(y) - 1) ELSE 0 END",
    "average": "list_avg(y)",
}
EVAL = f"WITH {DAILY}, {positions('daily')}, {cutting()}, {HIST}"


def daily_windows(spark, sf_dir, **options) -> DataFrame:
    return windows.split(nested(daily(spark, sf_dir)), CUTS, H, dynamic=["target", "users", "n_events", "mean_value"], **options)


def baseline_query(method: str) -> None:
    def f(spark, sf_dir):
        out = baselines.forecast(daily_windows(spark, sf_dir), method, ["target"], H, S)
        return out.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.posexplode("predictions").alias("step", "value")).select("window_idx", "id", F.col("step").cast("long").alias("step"), r("value", 7).alias("value"))

    query(f"{EVAL} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(step AS BIGINT) AS step, round({POINTS[method]}, 7) AS value FROM steps", method)(f)


for _m in POINTS:
    baseline_query(_m)

ERRORS = f"errors AS (SELECT window_idx, id, target - lag(target, {S}) OVER (PARTITION BY window_idx, id ORDER BY pos) AS e FROM past), offs AS (SELECT window_idx, id, {', '.join(f'coalesce(quantile_cont(e, {q}), 0) AS o{i}' for i, q in enumerate(LEVELS))}, avg(abs(e)) AS scale_abs, avg(e * e) AS scale_sq FROM errors GROUP BY 1, 2)"
FORE = f"points AS (SELECT window_idx, id, step, {POINTS['seasonal_naive']} AS p FROM steps), scored AS (SELECT f.window_idx, f.id, f.step, f.target AS y, p, {', '.join(f'p + o{i} AS q_{i}' for i in range(3))}, scale_abs, scale_sq FROM fut f JOIN points USING (window_idx, id, step) JOIN offs USING (window_idx, id))"


@query(f"{EVAL}, {ERRORS}, {FORE} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(step AS BIGINT) AS step, {', '.join(f'round(q_{i}, 5) AS q_{i}' for i in range(3))} FROM scored")
def residual_quantiles(spark, sf_dir):
    out = baselines.forecast(daily_windows(spark, sf_dir), "seasonal_naive", ["target"], H, S, LEVELS)
    z = F.arrays_zip(*(F.col(f"`{q}`").alias(f"q_{i}") for i, q in enumerate(LEVELS)))
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.posexplode(z).alias("step", "_v")).select("window_idx", "id", F.col("step").cast("long").alias("step"), *(r(f"_v.q_{i}", 5).alias(f"q_{i}") for i in range(3)))


ALPHAS = tuple(i / 20 for i in range(1, 20))
SES = f"grid AS (SELECT unnest([{', '.join(map(str, ALPHAS))}]::DOUBLE[]) AS a), ses AS (SELECT window_idx, id, y, a, 1 AS t, y[1] AS level, CAST(0 AS DOUBLE) AS squares FROM hist, grid UNION ALL SELECT window_idx, id, y, a, t + 1, level + a * (y[t + 1] - level), squares + (y[t + 1] - level) * (y[t + 1] - level) FROM ses WHERE t < len(y)), best AS (SELECT *, row_number() OVER (PARTITION BY window_idx, id ORDER BY squares, a) AS k FROM ses WHERE t = len(y)), line AS (SELECT window_idx, id, regr_slope(target, pos) AS b FROM past GROUP BY 1, 2)"


@query(f"{EVAL.replace('WITH', 'WITH RECURSIVE', 1)}, {SES} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(step AS BIGINT) AS step, round(level + b / 2 * (step + (1 - power(1 - a, t)) / a), 5) AS value FROM best JOIN line USING (window_idx, id) JOIN steps USING (window_idx, id) WHERE k = 1")
def theta(spark, sf_dir):
    """With the smoothing weight taken from a grid, as SQL can; ``alphas=None`` searches it."""
    out = smoothing.forecast(daily_windows(spark, sf_dir), "theta", ["target"], H, alphas=ALPHAS)
    return out.select("window_idx", "id", F.posexplode("predictions").alias("step", "value")).select("window_idx", "id", F.col("step").cast("long").alias("step"), r("value", 5).alias("value"))


DEMAND = "days AS (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS timestamp), buys AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS timestamp, sum(value) AS v FROM events GROUP BY 1, 2), demand AS (SELECT u.id, d.timestamp, coalesce(v, 0) AS target FROM (SELECT DISTINCT id FROM buys) u CROSS JOIN days d LEFT JOIN buys b ON b.id = u.id AND b.timestamp = d.timestamp)"


def user_demand(spark, sf_dir) -> DataFrame:
    """Nested: each user's value by day, 0 on days without an event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.to_date("ts").alias("day"), "value")
    low, high = e.agg(F.min("day"), F.max("day")).first()
    per_day = e.groupBy("id", "day").agg(F.sum("value").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("by_day"))  # a row for each day at most
    days = F.sequence(F.lit(low), F.lit(high), F.expr("interval 1 day"))
    return per_day.select("id", F.transform(days, lambda d: d.cast("timestamp_ntz")).alias("timestamp"), F.transform(days, lambda d: F.coalesce(F.try_element_at("by_day", d), F.lit(0.0))).alias("target"))


@query(f"WITH RECURSIVE {DEMAND}, {positions('demand')}, {cutting(CUTS)}, hits AS (SELECT window_idx, id, target AS y, pos - coalesce(lag(pos) OVER (PARTITION BY window_idx, id ORDER BY pos), -1) AS gap, row_number() OVER (PARTITION BY window_idx, id ORDER BY pos) AS k, count(*) OVER (PARTITION BY window_idx, id) AS n FROM past WHERE target <> 0), c AS (SELECT window_idx, id, k, n, CAST(y AS DOUBLE) AS size, CAST(gap AS DOUBLE) AS wait FROM hits WHERE k = 1 UNION ALL SELECT h.window_idx, h.id, h.k, h.n, c.size + 0.1 * (h.y - c.size), c.wait + 0.1 * (h.gap - c.wait) FROM c JOIN hits h ON h.window_idx = c.window_idx AND h.id = c.id AND h.k = c.k + 1) SELECT CAST(p.window_idx AS INT) AS window_idx, p.id, round(coalesce(c.size / c.wait, 0), 6) AS value FROM (SELECT DISTINCT window_idx, id FROM past) p LEFT JOIN c ON c.window_idx = p.window_idx AND c.id = p.id AND c.k = c.n")
def croston(spark, sf_dir):
    w = windows.split(user_demand(spark, sf_dir), CUTS, H)
    out = smoothing.forecast(w, "croston", ["target"], H)
    return out.select("window_idx", "id", r(F.get("predictions", F.lit(H - 1))).alias("value"))


TUNED = [autoregression.Candidate("none", (1,)), autoregression.Candidate("none", (7,)), autoregression.Candidate("difference", (7,))]
FITS = f"o AS (SELECT unnest([14, 7]) AS origin), z AS (SELECT *, target - lag(target) OVER w1 AS d, lag(target, 1) OVER w1 AS l1, lag(target, 7) OVER w1 AS l7 FROM pos WINDOW w1 AS (PARTITION BY id ORDER BY pos)), zz AS (SELECT *, lag(d, 7) OVER (PARTITION BY id ORDER BY pos) AS d7 FROM z), fit AS (SELECT origin, regr_slope(target, l1) FILTER (pos >= 7) AS b1, regr_intercept(target, l1) FILTER (pos >= 7) AS a1, regr_slope(target, l7) AS b7, regr_intercept(target, l7) AS a7, regr_slope(d, d7) AS bd, regr_intercept(d, d7) AS ad FROM zz, o WHERE pos < len - origin GROUP BY 1), ends AS (SELECT zz.*, fit.*, pos - (len - origin) + 1 AS h, max(CASE WHEN pos = len - origin - 1 THEN target END) OVER (PARTITION BY id, origin) AS y0 FROM zz, fit), fc AS (SELECT *, a1 * (1 - power(b1, h)) / (1 - b1) + power(b1, h) * y0 AS p1, a7 + b7 * l7 AS p7, y0 + sum(ad + bd * d7) OVER (PARTITION BY id, origin ORDER BY pos) AS pd FROM ends WHERE h BETWEEN 1 AND 7 AND len - origin >= 8)"


@query(f"WITH {DAILY}, {positions('daily')}, {FITS} SELECT origin AS origin, round(avg(abs(target - p1)), 4) AS none_1, round(avg(abs(target - p7)), 4) AS none_7, round(avg(abs(target - pd)), 4) AS difference_7 FROM fc GROUP BY 1")
def autoregression_tuning(spark, sf_dir):
    """Errors of three global autoregressions from two origins."""
    errors = autoregression.tune(nested(daily(spark, sf_dir)), "target", TUNED, H, (14, 7)).errors
    rows = [(o, *(round(errors[c, o], 4) for c in TUNED)) for o in (14, 7)]
    return spark.createDataFrame(rows, "origin int, none_1 double, none_7 double, difference_7 double")


@query(None)
def ets(spark, sf_dir):
    """Fitted weights have no SQL form; tests compare with a plain recursion and search."""
    out = smoothing.forecast(daily_windows(spark, sf_dir), "ets", ["target"], H, S, LEVELS)
    z = F.arrays_zip("predictions", *(F.col(f"`{q}`").alias(f"q_{i}") for i, q in enumerate(LEVELS)))
    return out.select("window_idx", "id", F.posexplode(z).alias("step", "_v")).select("window_idx", "id", F.col("step").cast("long").alias("step"), r("_v.predictions", 5).alias("value"), *(r(f"_v.q_{i}", 5).alias(f"q_{i}") for i in range(3)))


GAPPY = "gappy AS (SELECT *, CASE WHEN pos % 5 = 3 OR pos < 2 THEN NULL ELSE target END AS g FROM pos)"


def gappy(spark, sf_dir) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("id").orderBy("timestamp")) - 1
    return daily(spark, sf_dir).withColumn("pos", pos).withColumn("g", F.when((F.col("pos") % 5 == 3) | (F.col("pos") < 2), None).otherwise(F.col("target")))


def feature_query(name: str, make: Callable[[DataFrame], DataFrame], expression: str) -> None:
    def f(spark, sf_dir):
        return make(gappy(spark, sf_dir)).select("id", F.col("pos").cast("long").alias("pos"), r("out", 5).alias("out"))

    query(f"WITH {DAILY}, {positions('daily')}, {GAPPY} SELECT id, pos, round({expression}, 5) AS out FROM gappy", name)(f)


W_ID = "OVER (PARTITION BY id ORDER BY pos"
feature_query("ffill", lambda d: features.forward_fill(d.withColumn("out", F.col("g")), "out", otherwise=0.0), f"coalesce(last_value(g IGNORE NULLS) {W_ID}), 0)")
feature_query("bfill", lambda d: features.backward_fill(d.withColumn("out", F.col("g")), "out"), f"first_value(g IGNORE NULLS) {W_ID} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
feature_query("differences", lambda d: features.differences(d, "g", 7, "out"), f"g - lag(g, 7) {W_ID})")
feature_query("lag_feature", lambda d: features.lags(d, "g", [3]).withColumnRenamed("g_lag3", "out"), f"lag(g, 3) {W_ID})")
feature_query("rolling_mean", lambda d: features.rolling_mean(d, "g", 4, "out"), f"avg(g) {W_ID} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
feature_query("local_scaler", lambda d: features.local_scale(d, "g", "out"), "(g - avg(g) OVER (PARTITION BY id)) / stddev_samp(g) OVER (PARTITION BY id)")
feature_query("time_index", lambda d: features.time_index(d, "out"), "pos")


@query(f"WITH {DAILY}, {positions('daily')} SELECT id, pos - greatest(len - 5, 0) AS step, round(target, 6) AS value FROM pos WHERE pos >= len - 5")
def context_tail(spark, sf_dir):
    df = nested(daily(spark, sf_dir)).select("id", series.tail("target", 5).alias("v"))
    return df.select("id", F.posexplode("v").alias("step", "value")).select("id", F.col("step").cast("long").alias("step"), r("value").alias("value"))


@query(f"WITH RECURSIVE {DAILY}, {positions('daily')}, e AS (SELECT id, pos, target AS s FROM pos WHERE pos = 0 UNION ALL SELECT p.id, p.pos, 0.7 * e.s + 0.3 * p.target FROM e JOIN pos p ON p.id = e.id AND p.pos = e.pos + 1) SELECT id, pos, round(s, 5) AS out FROM e")
def ewm_mean(spark, sf_dir):
    df = nested(daily(spark, sf_dir)).select("id", series.ewm("target", 0.3).alias("v"))
    return df.select("id", F.posexplode("v").alias("pos", "out")).select("id", F.col("pos").cast("long").alias("pos"), r("out", 5).alias("out"))


@query(f"WITH {ORDERS} SELECT round(median(n), 6) AS median_length, min(n) AS min_length, max(n) AS max_length, count(*) AS n_series FROM (SELECT id, count(*) AS n FROM ord GROUP BY 1)")
def series_lengths(spark, sf_dir):
    out = features.length_statistics(monthly_orders(spark, sf_dir))
    return out.withColumn("median_length", r("median_length"))


@query("SELECT c_mktsegment AS segment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def ordinal_categories(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_mktsegment").alias("segment"))
    out = features.category_codes(c, ["c_mktsegment"])
    return out.groupBy("segment", F.col("c_mktsegment").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, round(sum(o_totalprice), 2) AS target, max(c_mktsegment) AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def static_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(r(F.sum("o_totalprice"), 2).alias("target"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    return features.with_statics(o, s)


# -- metrics ------------------------------------------------------------------------------------------


def scored(spark, sf_dir) -> DataFrame:
    w = daily_windows(spark, sf_dir)
    return metrics.scored_long(w, baselines.forecast(w, "seasonal_naive", ["target"], H, S, LEVELS), ["target"], S, LEVELS)


def ql(i: int) -> str:
    return f"2 * abs((y - q_{i}) * (CASE WHEN y <= q_{i} THEN 1 ELSE 0 END - {LEVELS[i]}))"


def fin(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def low(x: str, e: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, {float(e)}) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) END ELSE ({a}) / ({b}) END"


def metric_sql(e: float = 0.0) -> dict[str, list[str]]:
    """The aggregates of each metric for one target (quantile metrics: for each level)."""
    scale, scale2, size = low("scale_abs", e), low("scale_sq", e), low("avg(abs(y))", e)
    lg = "CASE WHEN {0} = -1 THEN CAST('-inf' AS DOUBLE) WHEN {0} > -1 THEN ln(1 + {0}) END"
    d = f"({lg.format('y')} - {lg.format('p')})"
    return {
        "MAE": ["avg(abs(y - p))"],
        "MAEB": ["avg(abs(y - p)) + abs(avg(p - y))"],
        "WAPE": [ratio("avg(abs(y - p))", size)],
        "WAPEB": [ratio("avg(abs(y - p)) + abs(avg(p - y))", size)],
        "MASE": [f"avg({fin(f'abs(y - p) / nullif({scale}, 0)')})"],
        "MSE": ["avg((y - p) * (y - p))"],
        "RMSE": ["sqrt(avg((y - p) * (y - p)))"],
        "RMSSE": [f"sqrt(avg({fin(f'(y - p) * (y - p) / nullif({scale2}, 0)')}))"],
        "RMSLE": [f"sqrt(avg({d} * {d}))"],
        "MAPE": [f"avg({fin('abs(y - p) / nullif(abs(y), 0)')})"],
        "SMAPE": [f"avg({fin('2 * abs(y - p) / nullif(abs(y) + abs(p), 0)')})"],
        "MQL": [f"avg({ql(i)})" for i in range(3)],
        "SQL": [f"avg({fin(f'{ql(i)} / nullif({scale}, 0)')})" for i in range(3)],
        "WQL": [ratio(f"avg({ql(i)})", size) for i in range(3)],
    }


SCORED = f"{EVAL}, {ERRORS}, {FORE}"


def one_metric(name: str, option: str | dict, sql_epsilon: float = 0.0) -> None:
    key = (option if isinstance(option, str) else option["name"]).upper()

    def f(spark, sf_dir):
        out = metrics.evaluate(scored(spark, sf_dir), [option], LEVELS)
        return out.select(F.col("window_idx").cast("int").alias("window_idx"), r(key, 5).alias("score"))

    parts = metric_sql(sql_epsilon)[key]
    total = " + ".join(f"({p})" for p in parts)
    query(f"{SCORED} SELECT CAST(window_idx AS INT) AS window_idx, round(({total}) / {len(parts)}, 5) AS score FROM scored GROUP BY 1", name)(f)


for _n in metrics.METRICS:
    one_metric(_n.lower(), _n)
one_metric("wape_epsilon", {"name": "WAPE", "epsilon": 1e6}, 1e6)
one_metric("mase_epsilon", {"name": "mase", "epsilon": 500.0}, 500.0)


@query(f"{SCORED} SELECT CAST(window_idx AS INT) AS window_idx, {', '.join(f'round({metric_sql()["SQL"][i]}, 5) AS level_{i}' for i in range(3))} FROM scored GROUP BY 1")
def sql_per_quantile(spark, sf_dir):
    out = metrics.evaluate(scored(spark, sf_dir), ["SQL"], LEVELS, per_quantile=True)
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), *(r(F.col(f"`SQL[{q}]`"), 5).alias(f"level_{i}") for i, q in enumerate(LEVELS)))


@query(f"WITH {SHIPDAY}, {positions('shipday')}, {cutting(LONG_CUTS)}, {HIST}, {ERRORS}, {FORE} SELECT CAST(window_idx AS INT) AS window_idx, round(avg(abs(y - p) / nullif(scale_abs, 0)), 5) AS mase, round(sqrt(avg((y - p) * (y - p) / nullif(scale_sq, 0))), 5) AS rmsse FROM scored GROUP BY 1")
def long_mase(spark, sf_dir):
    """Scales from all segments of the past, forecasts from its last season."""
    s = daily_segments(spark, sf_dir)
    cut = segments.cuts(s, LONG_CUTS, H)
    w = segments.windows(s, cut, H, S, ["target"], SIZE)
    scales = segments.seasonal_errors(s, cut, "target", S, SIZE).withColumn("target_name", F.lit("target"))
    scored_steps = metrics.scored_long(w, baselines.forecast(w, "seasonal_naive", ["target"], H, S), ["target"], S, scales=scales)
    out = metrics.evaluate(scored_steps, ["MASE", "RMSSE"])
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), r("MASE", 5).alias("mase"), r("RMSSE", 5).alias("rmsse"))


@query(f"{SCORED} SELECT CAST(window_idx AS INT) AS window_idx, id, round(min(scale_abs), 7) AS seasonal_abs, round(min(scale_sq), 3) AS seasonal_sq FROM scored GROUP BY 1, 2")
def seasonal_error(spark, sf_dir):
    w = daily_windows(spark, sf_dir)
    y = F.col("past").getField("target")
    return w.select(F.col("window_idx").cast("int").alias("window_idx"), "id", r(series.seasonal_error(y, S), 7).alias("seasonal_abs"), r(series.seasonal_error(y, S, True), 3).alias("seasonal_sq"))


@query(f"{SCORED} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(step AS BIGINT) AS step, {', '.join(f'round({ql(i)}, 5) AS loss_{i}' for i in range(3))} FROM scored")
def quantile_loss(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.col("step").cast("long").alias("step"), *(r(numeric.quantile_loss(F.col("y"), F.col(f"q_{i}"), q), 5).alias(f"loss_{i}") for i, q in enumerate(LEVELS)))


ODD = "odd AS (SELECT window_idx, id, step, CASE WHEN step = 2 THEN NULL WHEN step = 4 THEN 0 WHEN step = 5 AND id = 'click' THEN -1 ELSE y END AS y, CASE WHEN step = 4 AND window_idx = 1 THEN 0 ELSE p END AS p, q_0, q_1, q_2, CASE WHEN id = 'view' THEN 0 WHEN id = 'purchase' THEN NULL ELSE scale_abs END AS scale_abs, CASE WHEN id = 'view' THEN 0 ELSE scale_sq END AS scale_sq FROM scored)"


@query(f"{SCORED}, {ODD} SELECT CAST(window_idx AS INT) AS window_idx, {', '.join(f'round(({" + ".join(f"({p})" for p in v)}) / {len(v)}, 4) AS {k.lower()}' for k, v in metric_sql().items() if k != 'RMSLE')} FROM odd GROUP BY 1")
def metrics_with_nulls(spark, sf_dir):
    s = scored(spark, sf_dir)
    y = F.when(F.col("step") == 2, None).when(F.col("step") == 4, 0.0).when((F.col("step") == 5) & (F.col("id") == "click"), -1.0).otherwise(F.col("y"))
    odd = s.withColumns({
        "y": y,
        "p": F.when((F.col("step") == 4) & (F.col("window_idx") == 1), 0.0).otherwise(F.col("p")),
        "scale_abs": F.when(F.col("id") == "view", 0.0).when(F.col("id") == "purchase", None).otherwise(F.col("scale_abs")),
        "scale_sq": F.when(F.col("id") == "view", 0.0).otherwise(F.col("scale_sq")),
    })
    names = [m for m in metrics.METRICS if m != "RMSLE"]
    out = metrics.evaluate(odd, names, LEVELS)
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), *(r(m, 4).alias(m.lower()) for m in names))


TWO = f"long2 AS (SELECT window_idx, id, pos, idx, len, 'target' AS target_name, target AS v FROM kept UNION ALL SELECT window_idx, id, pos, idx, len, 'users', users FROM kept), sc AS (SELECT window_idx, id, target_name, avg(e) AS scale FROM (SELECT *, abs(v - lag(v, {S}) OVER (PARTITION BY window_idx, id, target_name ORDER BY pos)) AS e FROM long2 WHERE pos < idx) GROUP BY 1, 2, 3), sn AS (SELECT f.window_idx, f.id, f.target_name, abs(f.v - p.v) / nullif(scale, 0) AS e FROM long2 f JOIN long2 p ON f.window_idx = p.window_idx AND f.id = p.id AND f.target_name = p.target_name AND f.pos >= f.idx AND f.pos < f.idx + {H} AND p.pos = CASE WHEN f.idx >= {S} THEN f.idx - {S} + (f.pos - f.idx) % {S} ELSE f.idx - 1 END JOIN sc ON sc.window_idx = f.window_idx AND sc.id = f.id AND sc.target_name = f.target_name)"


def two_targets(spark, sf_dir) -> DataFrame:
    w = daily_windows(spark, sf_dir)
    s = metrics.scored_long(w, baselines.forecast(w, "seasonal_naive", ["target", "users"], H, S), ["target", "users"], S)
    return metrics.evaluate(s, ["MASE"])


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()}, {TWO} SELECT CAST(window_idx AS INT) AS window_idx, round(avg(m), 5) AS mase FROM (SELECT window_idx, target_name, avg(e) AS m FROM sn GROUP BY 1, 2) GROUP BY 1")
def multi_target_mean(spark, sf_dir):
    return two_targets(spark, sf_dir).select(F.col("window_idx").cast("int").alias("window_idx"), r("MASE", 5).alias("mase"))


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()}, {TWO} SELECT round(avg(w), 5) AS mase FROM (SELECT window_idx, avg(m) AS w FROM (SELECT window_idx, target_name, avg(e) AS m FROM sn GROUP BY 1, 2) GROUP BY 1)")
def window_mean(spark, sf_dir):
    return metrics.average_windows(two_targets(spark, sf_dir)).select(r("MASE", 5).alias("mase"))


# -- summaries and their analytics -------------------------------------------------------------------------

MODELS = tuple(sorted(POINTS))


def model_scores(spark, sf_dir) -> DataFrame:
    """Summaries: a task for each event type and window, scored by MASE for each baseline."""
    w = kept(daily_windows(spark, sf_dir), "windows")
    each = None
    for m in MODELS:
        s = metrics.scored_long(w, baselines.forecast(w, m, ["target"], H, S), ["target"], S).withColumn("model_name", F.lit(m))
        each = s if each is None else each.unionByName(s)
    found = metrics.evaluate(each, ["MASE"], by=["model_name", "id", "window_idx"])
    rank = F.array_position(F.array(*(F.lit(m) for m in MODELS)), F.col("model_name")).cast("double")
    values = {
        "dataset_path": F.lit("daily_events"), "dataset_config": F.col("id"), "horizon": F.lit(H), "initial_cutoff": F.get(F.array(*(F.lit(str(c)) for c in CUTS)), F.col("window_idx")), "min_context_length": F.lit(1), "max_context_length": F.lit(None), "seasonality": F.lit(S), "eval_metric": F.lit("MASE"), "extra_metrics": F.lit("[]"), "quantile_levels": F.lit("[]"),
        "id_column": F.lit("id"), "timestamp_column": F.lit("timestamp"), "target": F.lit("target"), "generate_univariate_targets_from": F.lit(None), "known_dynamic_columns": F.lit("[]"), "past_dynamic_columns": F.lit("[]"), "static_columns": F.lit("[]"),
        "test_error": F.when((F.col("model_name") == "average") & (F.col("id") == "click") & (F.col("window_idx") == 1), None).otherwise(F.col("MASE")),
        "training_time_s": rank * 2 + F.col("window_idx"), "inference_time_s": F.when(F.col("model_name") == "drift", None).otherwise(F.length("id") / 4.0 + rank), "trained_on_this_dataset": (F.col("model_name") == "drift") & (F.col("id") == "view"),
        "num_forecasts": F.when(F.col("model_name") == "naive", None).otherwise(10 + F.length("id")), "engine_version": F.lit("1.0.0"), "model_name": F.col("model_name"),
    }
    out = found.select(*(values[c].cast(k).alias(c) for c, k in analytics.RESULT_TYPES.items()))
    return kept(out.coalesce(1), "summaries")  # models x tasks rows, which the analytics check and read several times


EACH = " UNION ALL ".join(f"SELECT '{m}' AS model, {i + 1} AS rk, window_idx, id, step, {POINTS[m]} AS p FROM steps" for i, m in enumerate(MODELS))
SUMMARIES = f"{EVAL}, {ERRORS}, pts AS ({EACH}), raw AS (SELECT model, rk, pts.id, window_idx, CASE WHEN model = 'average' AND pts.id = 'click' AND window_idx = 1 THEN NULL ELSE avg(abs(f.target - p) / nullif(scale_abs, 0)) END AS score FROM pts JOIN fut f USING (window_idx, id, step) JOIN offs USING (window_idx, id) GROUP BY 1, 2, 3, 4), res AS (SELECT *, rk * 2.0 + window_idx AS tt, CASE WHEN model = 'drift' THEN NULL ELSE length(id) / 4.0 + rk END AS it, model = 'drift' AND id = 'view' AS leak, CASE WHEN model = 'naive' THEN NULL ELSE 10 + length(id) END AS nf FROM raw)"
REL = "rel AS (SELECT r.*, r.score / b.score AS err FROM res r JOIN res b ON b.id = r.id AND b.window_idx = r.window_idx AND b.model = 'seasonal_naive')"
CUTCASE = f"CASE window_idx WHEN 0 THEN '{CUTS[0]}' ELSE '{CUTS[1]}' END"


def task_id(df: DataFrame) -> DataFrame:
    """id and cutoff out of the task's key."""
    return df.withColumn("id", F.get_json_object("task", "$.dataset_config")).withColumn("cutoff", F.get_json_object("task", "$.initial_cutoff"))


def errors(spark, sf_dir) -> DataFrame:
    s = model_scores(spark, sf_dir)
    return analytics.relative_errors(analytics.grid(s, "test_error", MODELS, extra=["trained_on_this_dataset"]), "seasonal_naive")


@query(f"{SUMMARIES} SELECT id, {CUTCASE} AS cutoff, {', '.join(f"round(max(CASE WHEN model = '{m}' THEN score END), 5) AS {m}" for m in MODELS)} FROM res GROUP BY 1, 2")
def pivot_scores(spark, sf_dir):
    out = analytics.pivot_table(model_scores(spark, sf_dir))
    return out.select(F.col("dataset_config").alias("id"), F.col("initial_cutoff").alias("cutoff"), *(r(m, 5).alias(m) for m in MODELS))


@query(f"{SUMMARIES}, {REL} SELECT id, {CUTCASE} AS cutoff, model AS model_name, round(err, 5) AS score FROM rel")
def relative_error(spark, sf_dir):
    return task_id(errors(spark, sf_dir)).select("id", "cutoff", "model_name", r("score", 5).alias("score"))


@query(f"{SUMMARIES}, {REL} SELECT id, {CUTCASE} AS cutoff, model AS model_name, CASE WHEN err IS NOT NULL THEN round(least(greatest(err, 0.9), 1.1), 5) END AS score FROM rel")
def clip_error(spark, sf_dir):
    return task_id(analytics.clip_errors(errors(spark, sf_dir), 0.9, 1.1)).select("id", "cutoff", "model_name", r("score", 5).alias("score"))


@query(f"{SUMMARIES}, {REL} SELECT model AS model_name, count(*) AS tasks, round(sum(coalesce(err, 1.0)), 5) AS total FROM rel GROUP BY 1")
def impute_baseline(spark, sf_dir):
    return analytics.handle_missing(errors(spark, sf_dir), "impute", 1.0).groupBy("model_name").agg(F.count(F.lit(1)).alias("tasks"), r(F.sum("score"), 5).alias("total"))


DROP = "kept_tasks AS (SELECT * FROM rel WHERE (id, window_idx) NOT IN (SELECT (id, window_idx) FROM rel WHERE err IS NULL))"


@query(f"{SUMMARIES}, {REL}, {DROP} SELECT id, {CUTCASE} AS cutoff, model AS model_name, round(err, 5) AS score FROM kept_tasks")
def drop_incomplete(spark, sf_dir):
    return task_id(analytics.handle_missing(errors(spark, sf_dir), "drop")).select("id", "cutoff", "model_name", r("score", 5).alias("score"))


LEAK = "leaked AS (SELECT r.id, r.window_idx, r.model, CASE WHEN r.leak THEN b.err ELSE r.err END AS err FROM rel r JOIN rel b ON b.id = r.id AND b.window_idx = r.window_idx AND b.model = 'naive')"


@query(f"{SUMMARIES}, {REL}, {LEAK} SELECT id, {CUTCASE} AS cutoff, model AS model_name, round(err, 5) AS score FROM leaked")
def leakage_impute(spark, sf_dir):
    return task_id(analytics.impute_leakage(errors(spark, sf_dir), "naive")).select("id", "cutoff", "model_name", r("score", 5).alias("score"))


@query(f"{SUMMARIES}, {REL} SELECT model AS model_name, count(*) - count(err) AS num_failures FROM rel GROUP BY 1")
def num_failures(spark, sf_dir):
    return analytics.failures(errors(spark, sf_dir))


FILLED = "filled AS (SELECT id, window_idx, model, CASE WHEN err IS NULL THEN 1.0 ELSE round(least(greatest(err, 0.01), 100), 9) END AS e FROM rel)"
WINS = "SELECT a.model, b.model AS other, avg(CASE WHEN a.e < b.e THEN 1.0 WHEN a.e = b.e THEN 0.5 ELSE 0.0 END) AS w, 1 - exp(avg(ln(a.e / b.e))) AS skill FROM filled a JOIN filled b ON a.id = b.id AND a.window_idx = b.window_idx GROUP BY 1, 2"


def filled(spark, sf_dir) -> DataFrame:
    out = analytics.handle_missing(analytics.clip_errors(errors(spark, sf_dir), 0.01, 100.0), "impute", 1.0)
    return out.withColumn("score", F.round("score", 9))  # so that ties do not hang on the order of sums


@query(f"{SUMMARIES}, {REL}, {FILLED} SELECT model AS model_name, round(avg(w), 5) AS win_rate FROM ({WINS}) WHERE model <> other GROUP BY 1")
def win_rate(spark, sf_dir):
    return analytics.win_rates(filled(spark, sf_dir)).select("model_name", r("win_rate", 5).alias("win_rate"))


@query(f"{SUMMARIES}, {REL}, {FILLED} SELECT model AS model_name, round(1 - exp(avg(ln(e))), 5) AS skill_score FROM filled GROUP BY 1")
def skill_score(spark, sf_dir):
    return analytics.skill_scores(filled(spark, sf_dir)).select("model_name", r("skill_score", 5).alias("skill_score"))


@query(f"{SUMMARIES}, {REL}, {FILLED} SELECT model AS model_1, other AS model_2, round(w, 5) AS win_rate, round(skill, 5) AS skill_score FROM ({WINS})")
def pairwise_win_skill(spark, sf_dir):
    return analytics.pairwise(filled(spark, sf_dir)).select("model_1", "model_2", r("win_rate", 5).alias("win_rate"), r("skill_score", 5).alias("skill_score"))


@query(f"{SUMMARIES}, {REL}, {FILLED}, rk AS (SELECT model, rank() OVER (PARTITION BY id, window_idx ORDER BY e) + (count(*) OVER (PARTITION BY id, window_idx, e) - 1) / 2.0 AS r FROM filled) SELECT model AS model_name, round(avg(r), 5) AS mean_rank FROM rk GROUP BY 1")
def model_mean_rank(spark, sf_dir):
    return analytics.mean_ranks(filled(spark, sf_dir)).select("model_name", r("mean_rank", 5).alias("mean_rank"))


@query(f"{SUMMARIES} SELECT model AS model_name, round(median(tt), 5) AS training, round(median(it), 5) AS inference, round(median(tt + it), 5) AS total, round(avg(CAST(leak AS INT)), 5) AS overlap FROM res GROUP BY 1")
def runtime_median(spark, sf_dir):
    t = analytics.runtimes(model_scores(spark, sf_dir))
    return t.groupBy("model_name").agg(r(F.median("training_time_s"), 5).alias("training"), r(F.median("inference_time_s"), 5).alias("inference"), r(F.median("e2e_time_s"), 5).alias("total"), r(F.avg("overlap"), 5).alias("overlap"))


@query(f"{SUMMARIES}, n AS (SELECT id, window_idx, max(nf) AS n FROM res GROUP BY 1, 2) SELECT model AS model_name, round(median(tt / n * 100), 5) AS training, round(median((tt + it) / n * 100), 5) AS total FROM res JOIN n USING (id, window_idx) GROUP BY 1")
def runtime_per_n(spark, sf_dir):
    t = analytics.runtimes(model_scores(spark, sf_dir), 100)
    return t.groupBy("model_name").agg(r(F.median("training_time_s"), 5).alias("training"), r(F.median("e2e_time_s"), 5).alias("total"))


BOARD = f"{SUMMARIES}, {REL}, {LEAK}, filled AS (SELECT id, window_idx, model, CASE WHEN err IS NULL THEN 1.0 ELSE least(greatest(err, 0.01), 100) END AS e FROM leaked), wr AS (SELECT model, avg(w) AS w FROM ({WINS}) WHERE model <> other GROUP BY 1), sk AS (SELECT model, 1 - exp(avg(ln(e))) AS s FROM filled GROUP BY 1), nf AS (SELECT model, count(*) - count(err) AS f FROM leaked GROUP BY 1), rt AS (SELECT model, median(tt) AS t, median(it) AS i, median(tt + it) AS e2e, avg(CAST(leak AS INT)) AS o FROM res GROUP BY 1)"


@query(f"{BOARD} SELECT model AS model_name, round(w, 5) AS win_rate, round(s, 5) AS skill_score, round(t, 5) AS median_training_time_s, round(i, 5) AS median_inference_time_s, round(e2e, 5) AS median_e2e_time_s, round(o, 5) AS training_corpus_overlap, f AS num_failures FROM wr JOIN sk USING (model) JOIN nf USING (model) JOIN rt USING (model)")
def leaderboard(spark, sf_dir):
    out = analytics.leaderboard(model_scores(spark, sf_dir), missing_strategy="impute", leakage_imputation_model="naive")
    return out.select("model_name", *(r(c, 5).alias(c) for c in out.columns[1:-1]), "num_failures")


def drawn(n: int, resamples: int) -> str:
    """The bootstrap's counts of ``n`` tasks, a row for each resample."""
    return f"draws(d, w) AS (VALUES {', '.join(f'({i}, {list(x)})' for i, x in enumerate(analytics.resamples(n, resamples, 123)))})"


WON = "CASE WHEN a.e < b.e THEN 1.0 WHEN a.e = b.e THEN 0.5 ELSE 0.0 END"
BOUNDS = ", ".join(f"round(quantile_cont({c}, {q}), 5) AS {name}_{side}" for c, name in (("wr", "win_rate"), ("sk", "skill_score")) for q, side in ((0.025, "lower"), (0.975, "upper")))


@query(f"{BOARD}, {drawn(10, 1000)}, ord AS (SELECT id, window_idx, row_number() OVER (ORDER BY id, {CUTCASE}) AS k FROM (SELECT DISTINCT id, window_idx FROM filled)), duel AS (SELECT a.id, a.window_idx, a.model, avg({WON}) AS won FROM filled a JOIN filled b ON a.id = b.id AND a.window_idx = b.window_idx AND a.model <> b.model GROUP BY 1, 2, 3), st AS (SELECT f.model, d, sum(draws.w[k] * won) / 10 AS wr, 1 - exp(sum(draws.w[k] * ln(e)) / 10) AS sk FROM filled f JOIN duel USING (id, window_idx, model) JOIN ord USING (id, window_idx), draws GROUP BY 1, 2), iv AS (SELECT model, {BOUNDS} FROM st GROUP BY 1) SELECT model AS model_name, round(wr.w, 5) AS win_rate, win_rate_lower, win_rate_upper, round(s, 5) AS skill_score, skill_score_lower, skill_score_upper FROM wr JOIN sk USING (model) JOIN iv USING (model)")
def leaderboard_ci(spark, sf_dir):
    out = analytics.leaderboard(model_scores(spark, sf_dir), missing_strategy="impute", leakage_imputation_model="naive", n_resamples=1000)
    return out.select("model_name", *(r(c, 5).alias(c) for c in out.columns if c.startswith(("win_rate", "skill_score"))))


@query(f"{SUMMARIES}, p AS (SELECT r.id, r.window_idx, r.model, coalesce(r.score, b.score) AS e FROM res r JOIN res b ON b.id = r.id AND b.window_idx = r.window_idx AND b.model = 'seasonal_naive') SELECT a.model AS model_1, b.model AS model_2, round(avg(CASE WHEN a.e < b.e THEN 1.0 WHEN a.e = b.e THEN 0.5 ELSE 0.0 END), 5) AS win_rate, round(1 - exp(avg(ln(least(greatest(a.e / b.e, 0.01), 100)))), 5) AS skill_score FROM p a JOIN p b ON a.id = b.id AND a.window_idx = b.window_idx GROUP BY 1, 2")
def pairwise_comparison(spark, sf_dir):
    out = analytics.pairwise_comparison(model_scores(spark, sf_dir), missing_strategy="impute", baseline_model="seasonal_naive")
    return out.select("model_1", "model_2", r("win_rate", 5).alias("win_rate"), r("skill_score", 5).alias("skill_score"))


@query(f"{SUMMARIES}, {drawn(9, 200)}, filled AS (SELECT id, window_idx, model, score AS e FROM res WHERE (id, window_idx) NOT IN (SELECT (id, window_idx) FROM res WHERE score IS NULL)), ord AS (SELECT id, window_idx, row_number() OVER (ORDER BY id, {CUTCASE}) AS k FROM (SELECT DISTINCT id, window_idx FROM filled)), duel AS (SELECT a.id, a.window_idx, a.model AS model_1, b.model AS model_2, {WON} AS won, ln(least(greatest(a.e / b.e, 0.01), 100)) AS ratio FROM filled a JOIN filled b ON a.id = b.id AND a.window_idx = b.window_idx), st AS (SELECT model_1, model_2, d, sum(w[k] * won) / 9 AS wr, 1 - exp(sum(w[k] * ratio) / 9) AS sk FROM duel JOIN ord USING (id, window_idx), draws GROUP BY 1, 2, 3), iv AS (SELECT model_1, model_2, {BOUNDS} FROM st GROUP BY 1, 2), pt AS (SELECT model_1, model_2, round(avg(won), 5) AS win_rate, round(1 - exp(avg(ratio)), 5) AS skill_score FROM duel GROUP BY 1, 2) SELECT pt.*, win_rate_lower, win_rate_upper, skill_score_lower, skill_score_upper FROM pt JOIN iv USING (model_1, model_2)")
def pairwise_ci(spark, sf_dir):
    out = analytics.pairwise_comparison(model_scores(spark, sf_dir), missing_strategy="drop", n_resamples=200)
    return out.select("model_1", "model_2", *(r(c, 5).alias(c) for c in out.columns[2:]))


@query(f"{BOARD} SELECT model AS model_name, round(100 * w, 4) AS win_rate, round(100.0 * f / 10, 4) AS num_failures FROM wr JOIN nf USING (model) WHERE model = 'seasonal_naive' OR model IN (SELECT model FROM wr ORDER BY w DESC, model LIMIT 2)")
def top_models(spark, sf_dir):
    board = analytics.leaderboard(model_scores(spark, sf_dir), missing_strategy="impute", leakage_imputation_model="naive")
    out = analytics.top_models(analytics.percent(board, 10), 2, ["seasonal_naive"])
    return out.select("model_name", r("win_rate", 4).alias("win_rate"), r("num_failures", 4).alias("num_failures"))


@query(f"{SUMMARIES} SELECT model AS model_name, count(*) - count(score) AS n FROM res GROUP BY 1 HAVING count(*) > count(score)")
def submission_problems(spark, sf_dir):
    s = model_scores(spark, sf_dir).withColumn("task_name", F.concat_ws("|", "dataset_config", "initial_cutoff"))
    names = [row[0] for row in s.select("task_name").distinct().collect()]  # the tasks of a suite
    return analytics.submission_problems(s, names, ["model_name", "test_error"], ["test_error"]).select("model_name", "n")


# -- predictions -----------------------------------------------------------------------------------------------


@query(f"{EVAL} SELECT count(*) AS num_forecasts FROM hist")
def num_forecasts(spark, sf_dir):
    return baselines.forecast(daily_windows(spark, sf_dir), "naive", ["target"], H, S).agg(F.count(F.lit(1)).alias("num_forecasts"))


@query(f"{EVAL} SELECT CAST(window_idx AS INT) AS window_idx, min(CASE WHEN id LIKE '%a%' THEN id END) AS wrong_length, min(CASE WHEN id LIKE 'p%' THEN id END) AS not_finite, count(*) AS n_rows FROM hist GROUP BY 1")
def invalid_predictions(spark, sf_dir):
    f = baselines.forecast(daily_windows(spark, sf_dir), "naive", ["target"], H, S)
    broken = f.withColumn("predictions", F.when(F.col("id").contains("a"), F.slice("predictions", 1, 3)).otherwise(F.col("predictions"))).withColumn("predictions", F.when(F.col("id").startswith("p"), F.transform("predictions", lambda x: F.when(x > 0, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("predictions")))
    return predictions.problems(broken, H, key="id").select(F.col("window_idx").cast("int").alias("window_idx"), "wrong_length", "not_finite", "n_rows")


@query(f"WITH {DAILY}, {MELT}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT id FROM melted)) SELECT k // 2 AS item_ord, CASE k % 2 WHEN 0 THEN 'target' ELSE 'users' END AS target_name, id FROM o")
def combine_univariate(spark, sf_dir):
    melted = reshape.ordered(reshape.melt_targets(nested(daily(spark, sf_dir)), ["target", "users"], target_column="value"))
    return reshape.combine_univariate(melted.select("id", "item_ord"), ["target", "users"]).select(F.col("item_ord").cast("long").alias("item_ord"), "target_name", "id")


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()}, {HIST} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(step AS BIGINT) AS step, round(list_median([{', '.join(f'({POINTS[m]})' for m in MODELS)}]), 7) AS value FROM steps")
def ensemble_median(spark, sf_dir):
    w = daily_windows(spark, sf_dir)
    all_models = None
    for m in MODELS:
        f = baselines.forecast(w, m, ["target"], H, S)
        all_models = f if all_models is None else all_models.unionByName(f)
    out = predictions.ensemble(all_models, ["window_idx", "id", "target_name"])
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.posexplode("predictions").alias("step", "value")).select("window_idx", "id", F.col("step").cast("long").alias("step"), r("value", 7).alias("value"))


@query("SELECT CAST(user_id % 7 AS BIGINT) AS k, round(quantile_cont(value, 0.1), 5) AS q10, round(quantile_cont(value, 0.5), 5) AS q50, round(quantile_cont(value, 0.9), 5) AS q90 FROM events GROUP BY 1")
def sample_quantiles(spark, sf_dir):
    out = baselines.sample_quantiles(table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 7), ["k"], LEVELS)
    return out.select("k", *(r(F.get("quantiles", F.lit(i)), 5).alias(n) for i, n in enumerate(("q10", "q50", "q90"))))


@query(f"{EVAL} SELECT CAST(window_idx AS INT) AS window_idx, id, 'target' AS target_name, 'missing' AS side FROM hist WHERE id = 'click' UNION ALL SELECT CAST(window_idx AS INT), id, 'target', 'repeated' FROM hist WHERE id = 'view' UNION ALL SELECT DISTINCT CAST(window_idx AS INT), 'zz', 'target', 'surplus' FROM hist")
def prediction_mismatch(spark, sf_dir):
    w = daily_windows(spark, sf_dir)
    f = baselines.forecast(w, "naive", ["target"], H, S).select("window_idx", "id", "target_name")
    wrong = f.filter("id <> 'click'").unionByName(f.filter("id = 'view'")).unionByName(f.select("window_idx", F.lit("zz").alias("id"), "target_name").distinct())
    return predictions.unmatched(w, wrong, ["target"]).select(F.col("window_idx").cast("int").alias("window_idx"), "id", "target_name", "side")


@query("SELECT n_nationkey // 5 // 2 AS item_ord, CASE n_nationkey // 5 % 2 WHEN 0 THEN 'a' ELSE 'b' END AS target_name, CAST(n_nationkey % 5 AS BIGINT) AS step, CAST(n_regionkey AS BIGINT) AS value FROM nation")
def flat_forecasts(spark, sf_dir):
    flat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_regionkey").cast("long").alias("predictions"))
    out = reshape.flat_to_nested(flat, 5, ["a", "b"])
    return out.select("item_ord", "target_name", F.posexplode("predictions").alias("step", "value")).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {DAILY} SELECT CAST(count(*) > 0 AS BOOLEAN) AS long_is_long, CAST(count(*) < 0 AS BOOLEAN) AS nested_is_long FROM daily")
def long_or_nested(spark, sf_dir):
    d = daily(spark, sf_dir)
    flags = (reshape.is_long(d, "id", "timestamp"), reshape.is_long(nested(d), "id", "timestamp"))
    return spark.createDataFrame([flags], "long_is_long boolean, nested_is_long boolean")


@query("SELECT o_orderpriority AS id, CAST(i AS BIGINT) AS window_idx, strftime(CASE i WHEN 0 THEN d ELSE date_trunc('month', d) + i * INTERVAL 2 MONTH END, '%Y-%m-%d') AS cutoff FROM (SELECT o_orderpriority, CAST(min(o_orderdate) AS TIMESTAMP) + INTERVAL 1 DAY AS d FROM orders GROUP BY 1), range(4) t(i) WHERE day(d) > 1")
def cutoff_times(spark, sf_dir):
    """Offsets from each group's first day but one: the first cutoff as it is, then whole steps from it."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.min("o_orderdate").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("d")).filter(F.dayofmonth("d") > 1)
    found = [(row[0], i, t.strftime("%Y-%m-%d")) for row in o.collect() for i, t in enumerate(frequency.cutoff_times(row["d"], "2MS", 4))]  # a few priorities
    return spark.createDataFrame(found, "id string, window_idx long, cutoff string")


@query(f"WITH {DAILY} SELECT id, strftime(min(timestamp), '%Y-%m-%d') AS first_day, count(*) AS steps, round(sum(target), 4) AS total FROM daily GROUP BY 1")
def string_input(spark, sf_dir):
    """Ids and times that come as text."""
    text = daily(spark, sf_dir).select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "target")
    out = reshape.long_to_nested(text.withColumn("id", F.col("id").cast("binary").cast("string")), string_input=True)
    return out.select("id", F.date_format(F.get("timestamp", F.lit(0)), "yyyy-MM-dd").alias("first_day"), F.size("target").cast("long").alias("steps"), r(F.aggregate("target", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()} SELECT CAST(window_idx AS INT) AS window_idx, id || '_' || n AS id, strftime(timestamp, '%Y-%m-%d') AS day, n_events FROM fut, (SELECT unnest(['target', 'users']) AS n)")
def univariate_future(spark, sf_dir):
    """The future's rows, one copy for each target."""
    f = converted(spark, sf_dir, "item_id", True)["future"]
    return f.select(F.col("window_idx").cast("int").alias("window_idx"), F.col("item_id").alias("id"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "n_events")


@query(f"{EVAL} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(step AS BIGINT) AS step, round(CASE WHEN list_min(y) >= 0 THEN greatest({POINTS['drift']}, 0) ELSE {POINTS['drift']} END, 6) AS value FROM steps")
def clamped_forecast(spark, sf_dir):
    """No negative forecast of a series that never was negative."""
    w = daily_windows(spark, sf_dir)
    f = baselines.forecast(w, "drift", ["target"], H).join(w.select("window_idx", "id", F.col("past").getField("target").alias("y")), ["window_idx", "id"])
    out = f.select("window_idx", "id", F.posexplode(series.clamp_like("y", "predictions")).alias("step", "value"))
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.col("step").cast("long").alias("step"), r("value").alias("value"))


@query(f"WITH {DAILY}, {positions('daily')}, {GAPPY} SELECT id, pos, CASE WHEN id = 'click' THEN 0.0 ELSE round(g, 6) END AS out FROM gappy")
def zero_if_all_missing(spark, sf_dir):
    g = gappy(spark, sf_dir).withColumn("out", F.when(F.col("id") != "click", F.col("g")))
    return features.zero_if_all_missing(g, "out").select("id", F.col("pos").cast("long").alias("pos"), r("out").alias("out"))


@query(f"WITH {DAILY} SELECT 'D' AS freq, 'n_events' AS known, 'mean_value' AS past_only, CAST({H} AS INT) AS future_length, (SELECT count(DISTINCT id) FROM daily) AS series FROM daily GROUP BY 1")
def adapter_facts(spark, sf_dir):
    """What a library of entries is told beside its tables."""
    c = converted(spark, sf_dir, "entries")
    facts = c["past"].agg(F.count_distinct("id").alias("series"))
    return facts.select(F.lit(c["freq"]).alias("freq"), F.lit(",".join(c["known"])).alias("known"), F.lit(",".join(c["past_only"])).alias("past_only"), F.lit(c["future_length"]).alias("future_length"), "series")


@query(f"{SUMMARIES} SELECT model AS model_name, CAST(count(*) AS BIGINT) AS n, round(sum(score), 5) AS total FROM res WHERE model <> 'drift' AND {CUTCASE} = '{CUTS[1]}' GROUP BY 1")
def filtered_results(spark, sf_dir):
    s = model_scores(spark, sf_dir).withColumn("task_name", F.concat_ws("|", "dataset_config", "initial_cutoff"))
    names = [row[0] for row in s.filter(F.col("initial_cutoff") == str(CUTS[1])).select("task_name").distinct().collect()]  # the tasks of a suite
    kept = analytics.filter_tasks(analytics.filter_models(s, excluded=["drift"]), names)
    return kept.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("test_error"), 5).alias("total"))


@query("SELECT c_mktsegment AS model_name, 'balance' AS target, '[0.1, 0.0001, 1.0]' AS quantile_levels, CAST(8 AS BIGINT) AS horizon, '1.0.0' AS engine_version, CAST(NULL AS VARCHAR) AS initial_cutoff, round(sum(c_acctbal), 2) AS test_error FROM customer GROUP BY 1")
def loaded_summaries(spark, sf_dir):
    """Former names, text in place of numbers, levels in one form, missing columns as null."""
    import warnings

    from .sources import summaries

    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("model_name")).agg(F.sum("c_acctbal").cast("string").alias("test_error"))
    raw = c.withColumns({"target_column": F.lit("balance"), "quantile_levels": F.lit("[0.1, 0.00010000001, 1.0]"), "horizon": F.lit("8"), "tool_version": F.lit("1.0.0")})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of the columns that are filled
        out = summaries.load(spark, raw)
    return out.select("model_name", "target", "quantile_levels", "horizon", "engine_version", "initial_cutoff", r("test_error", 2).alias("test_error"))


@query("SELECT r_name AS name, 'v1' AS suite FROM region")
def constant_column(spark, sf_dir):
    from .sources import summaries

    return summaries.add_constant(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("suite")), "suite", "v1")


DRAWS = 100
_counts = analytics.resamples(10, DRAWS, 123)
INDEX = f"draws(d, w) AS (VALUES {', '.join(f'({i}, {list(x)})' for i, x in enumerate(_counts))})"


@query(f"{SUMMARIES}, {REL}, {FILLED}, {INDEX}, placed AS (SELECT model, e, row_number() OVER (PARTITION BY model ORDER BY id, {CUTCASE}) AS k FROM filled), stats AS (SELECT model, d, sum(w[k] * e) / sum(w[k]) AS m FROM placed, draws GROUP BY 1, 2) SELECT model AS model_name, round(quantile_cont(m, 0.05), 5) AS lower, round(quantile_cont(m, 0.95), 5) AS upper FROM stats GROUP BY 1")
def bootstrap_interval(spark, sf_dir):
    s = model_scores(spark, sf_dir)
    placed = analytics.number_tasks(filled(spark, sf_dir), s, analytics.TASK_COLUMNS)
    out = analytics.intervals(placed, ["model_name"], "score", DRAWS, 123, 0.1, False)
    return out.select("model_name", r("lower", 5).alias("lower"), r("upper", 5).alias("upper"))


# -- adapters -----------------------------------------------------------------------------------------------------


def converted(spark, sf_dir, adapter: str, univariate: bool = False) -> dict:
    w = daily_windows(spark, sf_dir)
    targets = ["target", "users"] if univariate else ["target"]
    past = windows.past(w, [*targets, "n_events", "mean_value"])
    return adapters.convert(past, windows.future(w, ["n_events"]), adapter, targets=targets, univariate=univariate, target_column="value" if univariate else "target")


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()} SELECT CAST(window_idx AS INT) AS window_idx, id AS unique_id, strftime(timestamp, '%Y-%m-%d') AS ds, round(target, 6) AS y, n_events FROM past")
def unique_id_past(spark, sf_dir):
    p = converted(spark, sf_dir, "unique_id")["past"]
    return p.select(F.col("window_idx").cast("int").alias("window_idx"), "unique_id", F.date_format("ds", "yyyy-MM-dd").alias("ds"), r("y").alias("y"), "n_events")


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()} SELECT CAST(window_idx AS INT) AS window_idx, id AS unique_id, strftime(timestamp, '%Y-%m-%d') AS ds, n_events FROM fut")
def unique_id_future(spark, sf_dir):
    f = converted(spark, sf_dir, "unique_id")["future"]
    return f.select(F.col("window_idx").cast("int").alias("window_idx"), "unique_id", F.date_format("ds", "yyyy-MM-dd").alias("ds"), "n_events")


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()} SELECT CAST(window_idx AS INT) AS window_idx, id, count(*) AS steps, count(t) AS known, round(sum(n_events), 4) AS covariate FROM (SELECT window_idx, id, target AS t, n_events FROM past UNION ALL SELECT window_idx, id, NULL, n_events FROM fut) GROUP BY 1, 2")
def past_plus_future(spark, sf_dir):
    p = converted(spark, sf_dir, "entries")["prediction"]
    return p.groupBy(F.col("window_idx").cast("int").alias("window_idx"), "id").agg(F.count(F.lit(1)).alias("steps"), F.count("target").alias("known"), r(F.sum(F.col("n_events").cast("double")), 4).alias("covariate"))


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()} SELECT CAST(window_idx AS INT) AS window_idx, id, CAST(count(*) AS BIGINT) AS covariate_steps, round(sum(n_events), 4) AS covariate FROM (SELECT window_idx, id, n_events FROM past UNION ALL SELECT window_idx, id, n_events FROM fut) GROUP BY 1, 2")
def covariate_series(spark, sf_dir):
    s = converted(spark, sf_dir, "covariates")["series"]
    return s.select(F.col("window_idx").cast("int").alias("window_idx"), "id", F.size("n_events").cast("long").alias("covariate_steps"), r(F.aggregate("n_events", F.lit(0.0), lambda a, b: a + b), 4).alias("covariate"))


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()} SELECT CAST(window_idx AS INT) AS window_idx, id || '_' || n AS id, count(*) AS steps, round(sum(v), 4) AS total FROM (SELECT window_idx, id, 'target' AS n, target AS v FROM past UNION ALL SELECT window_idx, id, 'users', users FROM past) GROUP BY 1, 2")
def as_univariate(spark, sf_dir):
    p = converted(spark, sf_dir, "item_id", True)["past"]
    return p.groupBy(F.col("window_idx").cast("int").alias("window_idx"), F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("steps"), r(F.sum("target"), 4).alias("total"))


# -- whole tasks -----------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY}, {positions('daily')}, {cutting()}, {TWO}, e AS (SELECT window_idx, target_name, avg(e) AS m FROM sn GROUP BY 1, 2), w AS (SELECT window_idx, avg(m) AS m FROM e GROUP BY 1) SELECT 'seasonal_naive' AS model_name, round(avg(m), 5) AS test_error, (SELECT CAST(2 * count(DISTINCT id) * 2 AS BIGINT) FROM kept) AS num_forecasts FROM w")
def evaluation_summary(spark, sf_dir):
    from .plans.model import SeasonalNaiveModel, run
    from .plans.task import Task

    task = Task("daily_events", "daily_events", horizon=H, num_windows=2, seasonality=S, eval_metric="MASE", target=["target", "users"]).use(daily(spark, sf_dir))
    row = run(spark, SeasonalNaiveModel(), [task])[0]
    return spark.createDataFrame([(row["model_name"], round(row["test_error"], 5), row["num_forecasts"])], "model_name string, test_error double, num_forecasts long")


STREAMED = f"{EVAL}, {ERRORS}, {FORE} SELECT CAST(window_idx AS INT) AS window_idx, count(y) AS n, round(avg(abs(y - p)), 5) AS mae, round(sum(abs(y - p)) / sum(abs(y)), 5) AS wape, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs(y - p) / nullif(scale_abs, 0)), 5) AS mase FROM scored GROUP BY 1"


@query(STREAMED)
def streaming_scores(spark, sf_dir):
    """The stream's sums, here fed with a table (tests feed it with a stream)."""
    from .streaming import scores as stream

    w = daily_windows(spark, sf_dir)
    f = baselines.forecast(w, "seasonal_naive", ["target"], H, S).join(w.select("window_idx", "id", F.col("future.timestamp").alias("timestamp"), series.seasonal_error(F.col("past").getField("target"), S).alias("scale_abs")), ["window_idx", "id"])
    actuals = daily(spark, sf_dir).select("id", F.lit("target").alias("target_name"), "timestamp", F.col("target").alias("y"))
    out = stream.scores(stream.error_sums(actuals, stream.step_forecasts(f, ("scale_abs",))))
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "n", r("MAE", 5).alias("mae"), r("WAPE", 5).alias("wape"), r("RMSE", 5).alias("rmse"), r("MASE", 5).alias("mase"))


@query(STREAMED)
def stateful_scores(spark, sf_dir):
    """A real stream of the daily values in two runs: the second restarts from the state that the
    first left.  Seasonal errors are the state's own."""
    from .sources.shared import folder
    from .streaming import scores as stream
    from .streaming import stateful

    w = daily_windows(spark, sf_dir)
    f = baselines.forecast(w, "seasonal_naive", ["target"], H, S).join(w.select("window_idx", "id", F.col("future.timestamp").alias("timestamp")), ["window_idx", "id"])
    actuals = kept(daily(spark, sf_dir).select("id", "timestamp", F.col("target").alias("y")), "actuals")
    days = actuals.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    middle = days["a"] + (days["b"] - days["a"]) * 2 / 3
    own = stateful.session(spark, 4)
    forecasts = own.read.parquet(*kept(stream.step_forecasts(f), "forecasts").inputFiles())
    base = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in (F.col("timestamp") <= F.lit(middle), F.col("timestamp") > F.lit(middle)):
        actuals.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = own.readStream.schema(actuals.schema).parquet(f"{base}/in")
        stateful.start(stateful.score_stream(source, forecasts, S), f"{base}/out", f"{base}/state").awaitTermination()
    out = stream.scores(stateful.latest(spark, f"{base}/out"))
    return out.select(F.col("window_idx").cast("int").alias("window_idx"), "n", r("MAE", 5).alias("mae"), r("WAPE", 5).alias("wape"), r("RMSE", 5).alias("rmse"), r("MASE", 5).alias("mase"))

"""Frequencies: names, seasons, and whether a series is regular."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col

#: Steps in a season by the leading part of a frequency's name (fixed values).
SEASONS = {"YE": 1, "YS": 1, "Y": 1, "A": 1, "QE": 4, "QS": 4, "Q": 4, "ME": 12, "MS": 12, "M": 12, "W": 1, "D": 7, "B": 5, "h": 24, "H": 24, "min": 1440, "T": 1440, "s": 3600, "S": 3600}
#: Names of periods for names of their starts and ends (fixed values).
PERIODS = {"ME": "M", "MS": "M", "QE": "Q", "QS": "Q", "YE": "Y", "YS": "Y"}


def season_of(freq: str) -> int:
    """Steps in the usual season of a frequency; 1 where no whole number of steps fits."""
    offset = pd.tseries.frequencies.to_offset(freq)
    base = SEASONS.get(offset.name.split("-")[0], 1)
    return base // offset.n if offset.n <= base and base % offset.n == 0 else 1


def seconds_of(freq: str) -> float:
    """Length of a step in seconds (calendar steps: from the start of 2000)."""
    offset = pd.tseries.frequencies.to_offset(freq)
    start = pd.Timestamp("2000-01-01") + 0 * offset
    start = offset.rollforward(start) if hasattr(offset, "rollforward") else start
    return (start + offset - start).total_seconds()


def period_alias(freq: str) -> str:
    offset = pd.tseries.frequencies.to_offset(freq)
    head, _, anchor = offset.name.partition("-")
    name = PERIODS.get(head, head) + (f"-{anchor}" if anchor and not head.startswith("M") else "")
    return name if offset.n == 1 else f"{offset.n}{name}"


def cutoff_times(start: str, step: str | int, windows: int, freq: str | None = None) -> list[pd.Timestamp]:
    """Cutoffs from a timestamp: the first as it is, then whole offsets from it."""
    offset = pd.tseries.frequencies.to_offset(step if isinstance(step, str) else freq)
    if isinstance(step, int):
        offset = offset * step
    first = pd.Timestamp(start)
    return [first if i == 0 else first + i * offset for i in range(windows)]


def infer(timestamps) -> str | None:
    """The name of the frequency of one series, or None."""
    index = pd.DatetimeIndex(timestamps)
    return pd.infer_freq(index) if len(index) >= 3 else None


def regular_delta(timestamps: Column | str) -> Column:
    """The constant number of seconds between neighbours, null if it varies."""
    t = F.transform(col(timestamps), lambda x: F.unix_micros(x.cast("timestamp")))
    n = F.size(t) - 1
    steps = F.when(n > 0, F.zip_with(F.slice(t, F.lit(2), n), F.slice(t, F.lit(1), n), lambda a, b: a - b)).otherwise(F.array().cast("array<bigint>"))
    distinct = F.array_distinct(steps)
    return F.when((F.size(distinct) == 1) & (distinct[0] > 0), distinct[0] / 1e6)


def regular_months(timestamps: Column | str) -> Column:
    """The constant number of months between neighbours that share their day of the
    month (or are all last days), null otherwise."""
    t = col(timestamps)
    months = F.transform(t, lambda x: F.year(x) * 12 + F.month(x))
    n = F.size(t) - 1
    steps = F.array_distinct(F.when(n > 0, F.zip_with(F.slice(months, F.lit(2), n), F.slice(months, F.lit(1), n), lambda a, b: a - b)).otherwise(F.array().cast("array<int>")))
    clock = lambda x: F.date_format(x, "HH:mm:ss.SSSSSS")
    day = F.size(F.array_distinct(F.transform(t, lambda x: F.concat(F.dayofmonth(x), F.lit(" "), clock(x))))) == 1
    last = (F.size(F.array_distinct(F.transform(t, clock))) == 1) & F.forall(t, lambda x: F.last_day(x) == F.to_date(x))
    return F.when((F.size(steps) == 1) & (steps[0] > 0) & (day | last), steps[0])


#: Names of weekdays from Monday, and of months (fixed values).
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Microseconds of the units of constant steps, the longest first (fixed values).
UNITS = {"h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
_DAY = 86_400_000_000


def _neighbours(v: Column) -> Column:
    """Differences of neighbours; empty for fewer than two."""
    n = F.size(v) - 1
    return F.when(n > 0, F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(1), n), lambda a, b: a - b)).otherwise(F.slice(v, 1, 0))


def _counted(n: Column, name: Column) -> Column:
    return F.concat(F.when(n == 1, F.lit("")).otherwise(n.cast("string")), name)


def _pick(names: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in names)), k.cast("int"))


def name_of(timestamps: Column | str) -> Column:
    """The frequency's name of a series, as pandas tells it (``W-SUN``, ``QS-OCT``, ``B``,
    ``WOM-2TUE``, ``15min``), null where there is none or fewer than three steps.

    Expressions only.  Steps of whole days are tried as years, quarters, months (at the
    calendar's or the business days' first or last day), weeks and days, business days, and
    weeks of a month, in this order; shorter ones as multiples of a unit.
    """
    t = F.transform(col(timestamps), lambda x: x.cast("timestamp"))
    facts = F.struct(
        F.transform(t, lambda x: F.unix_micros(x)).alias("us"), F.transform(t, lambda x: F.dayofmonth(x)).alias("day"), F.transform(t, lambda x: F.weekday(x)).alias("weekday"),
        F.transform(t, lambda x: F.year(x) * 12 + F.month(x) - 1).alias("month"), F.transform(t, lambda x: F.dayofmonth(F.last_day(x))).alias("days"),
    )

    def told(f: Column) -> Column:
        steps = F.sort_array(F.array_distinct(_neighbours(f["us"])))
        months = F.array_distinct(_neighbours(f["month"]))
        years = F.array_distinct(_neighbours(F.transform(f["month"], lambda m: F.floor(m / 12).cast("int"))))
        least, one = F.get(steps, F.lit(0)), F.size(steps) == 1
        place = F.arrays_zip(f["day"].alias("d"), f["days"].alias("n"), f["weekday"].alias("w"))
        at = lambda rule: F.forall(place, rule)
        where = (
            F.when(at(lambda x: x["d"] == x["n"]), F.array(F.lit("E"), F.lit("")))
            .when(at(lambda x: (x["d"] == x["n"]) | ((x["n"] - x["d"] < 3) & (x["w"] == 4))), F.array(F.lit("E"), F.lit("B")))
            .when(at(lambda x: x["d"] == 1), F.array(F.lit("S"), F.lit("")))
            .when(at(lambda x: (x["d"] == 1) | ((x["d"] <= 3) & (x["w"] == 0))), F.array(F.lit("S"), F.lit("B")))
        )
        calendar = lambda unit: F.concat(where[1], F.lit(unit), where[0])
        month_of, first, weekday = F.get(f["month"], F.lit(0)) % 12, F.get(months, F.lit(0)), F.get(f["weekday"], F.lit(0))
        same_month = F.size(F.array_distinct(F.transform(f["month"], lambda m: m % 12))) == 1
        quarter_end = _pick(("OCT", "NOV", "DEC"), month_of % 3)  # the quarter's anchor, by its position
        yearly = F.when((F.size(years) == 1) & same_month, _counted(F.get(years, F.lit(0)), F.concat(calendar("Y"), F.lit("-"), _pick(MONTHS, month_of))))
        quarterly = F.when((F.size(months) == 1) & (first % 3 == 0), _counted(F.floor(first / 3), F.concat(calendar("Q"), F.lit("-"), quarter_end)))
        monthly = F.when(F.size(months) == 1, _counted(first, calendar("M")))
        span = F.floor(least / _DAY)
        daily = F.when(one & (span % 7 == 0), _counted(F.floor(span / 7), F.concat(F.lit("W-"), _pick(WEEKDAYS, weekday)))).when(one, _counted(span, F.lit("D")))
        gaps = F.zip_with(F.slice(f["weekday"], F.lit(2), F.size(t)), _neighbours(f["us"]), lambda w, g: ((w == 0) & (g == 3 * _DAY)) | ((w > 0) & (w <= 4) & (g == _DAY)))
        business = F.when((F.size(steps) == 2) & (steps[0] == _DAY) & (F.element_at(steps, -1) == 3 * _DAY) & F.forall(gaps, lambda ok: ok), F.lit("B"))
        weeks = F.filter(F.array_distinct(F.transform(f["day"], lambda d: F.floor((d - 1) / 7))), lambda w: w < 4)
        of_month = F.when((F.size(F.array_distinct(f["weekday"])) == 1) & (F.size(weeks) == 1), F.concat(F.lit("WOM-"), (F.get(weeks, F.lit(0)) + 1).cast("string"), _pick(WEEKDAYS, weekday)))
        whole_days = F.coalesce(yearly, quarterly, monthly, daily, business, of_month)
        hours = F.transform(steps, lambda x: x / UNITS["h"])
        office = F.when(F.array_join(F.transform(hours, lambda x: x.cast("string")), ",").isin("1.0,17.0", "1.0,65.0", "1.0,17.0,65.0"), F.lit("bh"))
        short = F.lit(None).cast("string")
        for unit, micros in reversed(UNITS.items()):
            short = F.when(least % micros == 0, _counted(F.floor(least / micros), F.lit(unit))).otherwise(short)
        return F.when(least > 0, F.when(least % _DAY == 0, whole_days).otherwise(F.coalesce(office, F.when(one, short))))

    complete = (F.size(t) >= 3) & F.forall(t, lambda x: x.isNotNull())
    return F.when(complete, F.transform(F.array(facts), told)[0])


def with_regularity(df: DataFrame, timestamps: str, name: str = "regular") -> DataFrame:
    """Adds whether a series is regular: whether its frequency has a name (``name_of``)."""
    return df.withColumn(name, F.coalesce(name_of(timestamps).isNotNull(), F.lit(False)))

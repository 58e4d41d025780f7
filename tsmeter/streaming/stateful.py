"""Scores of a stream of actual values, with the state of each series in the engine.

A series' steps may arrive late and in any order within the watermark's delay.  Its state is a
ring of the last season's values and the running seasonal error (so a window's scale is
known when its first step comes), the steps that wait for an earlier one, and the sums of each
window.  A step is scored at once if it follows the last one; otherwise it waits until
the gap is filled or a timer at its own time says that the watermark has passed it: then the
missing steps count as null.  The state of a series is one season, the steps within the delay and one row
for each window, whatever the length of the stream.

Queries restart from their checkpoint; the sink writes each batch to a folder of its own
number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numeric import known
from .scores import SUMS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "id string, window_idx int, seen long, n long, sum_abs double, sum_err double, sum_sq double, sum_truth double, sum_scaled double, n_scaled long"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class SeriesScores(StatefulProcessor):
    """``season`` in steps, ``step`` in milliseconds."""

    def __init__(self, season: int, step: int):
        self.season, self.step = season, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last long, ring array<double>, total double, pairs long")
        self.waiting = handle.getMapState("waiting", "at long", "y double, windows array<int>, points array<double>")
        self.sums = handle.getMapState("sums", "window_idx int", "seen long, n long, sum_abs double, sum_err double, sum_sq double, sum_truth double, sum_scaled double, n_scaled long, scale double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        clock = self._clock()
        new = {}
        for frame in rows:
            for at, y, windows, points in zip(frame["at"].tolist(), frame["y"].tolist(), frame["windows"], frame["points"]):
                if clock["last"] is None or at > clock["last"]:  # a step that was passed is not scored again
                    new[int(at)] = (None if pd.isna(y) else float(y), [int(w) for w in windows], [None if pd.isna(p) else float(p) for p in points])
        touched: dict[int, list] = {}
        for at in sorted(new):
            if clock["last"] is not None and at == clock["last"] + self.step:
                self._score(clock, touched, at, *new[at])
                self._follow(clock, touched)
            elif at > (clock["last"] if clock["last"] is not None else at - 1):
                if not self.waiting.containsKey((at,)):
                    self.handle.registerTimer(at)
                self.waiting.updateValue((at,), new[at])
        yield self._out(key, clock, touched)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        clock, touched = self._clock(), {}
        now = expiredTimerInfo.getExpiryTimeInMs()
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= now):
            if clock["last"] is not None:
                missing = (at - clock["last"]) // self.step - 1
                clock["ring"] = [*clock["ring"], *[None] * min(missing, self.season)][-self.season :]
            self._take(clock, touched, at)
        self._follow(clock, touched)
        yield self._out(key, clock, touched)

    def close(self) -> None:
        pass

    def _clock(self) -> dict:
        if not self.clock.exists():
            return {"last": None, "ring": [], "total": 0.0, "pairs": 0}
        last, ring, total, pairs = self.clock.get()
        return {"last": last, "ring": list(ring), "total": total, "pairs": pairs}

    def _take(self, clock: dict, touched: dict, at: int) -> None:
        y, windows, points = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        self._score(clock, touched, at, y, list(windows), list(points))

    def _follow(self, clock: dict, touched: dict) -> None:
        """The waiting steps that now follow."""
        while clock["last"] is not None and self.waiting.containsKey((clock["last"] + self.step,)):
            at = clock["last"] + self.step
            self.handle.deleteTimer(at)
            self._take(clock, touched, at)

    def _score(self, clock: dict, touched: dict, at: int, y: float | None, windows: list[int], points: list[float | None]) -> None:
        for w, p in zip(windows, points):
            if w not in touched:
                touched[w] = list(self.sums.getValue((w,))) if self.sums.containsKey((w,)) else [0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, clock["total"] / clock["pairs"] if clock["pairs"] else None]
            s = touched[w]
            s[0] += 1
            if y is not None:
                s[1] += 1
                s[5] += abs(y)
            if y is not None and p is not None:
                s[2] += abs(y - p)
                s[3] += p - y
                s[4] += (y - p) ** 2
                if s[8]:
                    s[6] += abs(y - p) / s[8]
                    s[7] += 1
        ring = clock["ring"]
        if len(ring) == self.season and ring[0] is not None and y is not None:
            clock["total"] += abs(y - ring[0])
            clock["pairs"] += 1
        clock["ring"], clock["last"] = [*ring, y][-self.season :], at

    def _out(self, key: Any, clock: dict, touched: dict) -> pd.DataFrame:
        if clock["last"] is not None:
            self.clock.update((clock["last"], clock["ring"], clock["total"], clock["pairs"]))
        for w, s in touched.items():
            self.sums.updateValue((w,), tuple(s))
        return pd.DataFrame([(key[0], w, *s[:8]) for w, s in sorted(touched.items())], columns=COLUMNS)


def with_forecasts(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """``actuals`` (a stream: id, timestamp, y) with the forecasts of each step (a table:
    window_idx, id, timestamp, p) as two arrays; the table is joined by (id, timestamp)."""
    by_step = forecasts.groupBy("id", "timestamp").agg(F.array_sort(F.collect_list(F.struct("window_idx", known("p").alias("p")))).alias("_f"))
    joined = actuals.join(by_step, ["id", "timestamp"], "left")
    arrays = [F.coalesce(F.col("_f.window_idx"), F.array().cast("array<int>")).alias("windows"), F.coalesce(F.col("_f.p"), F.array().cast("array<double>")).alias("points")]
    return joined.select("id", "event_time", F.unix_millis("event_time").alias("at"), known("y").alias("y"), *arrays)


def score_stream(actuals: DataFrame, forecasts: DataFrame, season: int, step: str = "1 day", late: str = "1 day") -> DataFrame:
    """The running sums of each (id, window), a row whenever they change (update mode).

    ``actuals``: a stream with id, timestamp, y.  ``step``: the time between two steps;
    ``late``: the watermark's delay.
    """
    spark = actuals.sparkSession
    millis = int(spark.range(1).select(F.unix_millis(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {step}"))).first()[0])
    timed = actuals.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", late)
    keyed = with_forecasts(timed, forecasts).groupBy("id")
    return keyed.transformWithStateInPandas(SeriesScores(season, millis), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own for stateful queries: the store that timers need, and how many
    partitions the state is dealt to (fixed by a query's first run)."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def start(running: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """A running query that writes each batch's rows to ``path``/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = running.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """window_idx, target_name and the sums over all series: the input of ``scores.scores``."""
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(path)
    last = rows.groupBy("id", "window_idx").agg(F.max_by(F.struct(*SUMS), F.struct("seen", "batch")).alias("s"))
    return last.groupBy("window_idx").agg(*(F.sum(F.col("s").getField(c)).alias(c) for c in SUMS)).withColumn("target_name", F.lit("target"))

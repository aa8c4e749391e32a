"""Error bursts and repeated errors on streams: keyed state that survives restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberlog.functions.levels import is_error, is_exact_error
from emberlog.functions.text import normalize_message
from emberlog.functions.times import MICROS, from_micros, instant, micros
from emberlog.operators.ordered import row_key
from emberlog.operators.patterns import detection_rows
from emberlog.schemas import (BURST_COOLDOWN_SECONDS, BURST_THRESHOLD, BURST_WINDOW_SECONDS,
                              REPEAT_PREFIX_CHARS, REPEAT_RELATED_LOGS, REPEAT_THRESHOLD,
                              REPEAT_WINDOW_SECONDS)
from emberlog.session import ROCKSDB, STATE_STORE

LOG_COLUMNS = ["id", "source", "content", "us"]
BURST_COLUMNS = ["scope", "id", "source", "content", "log_level", "us"]


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB, checkpointed with the stream."""
    spark.conf.set(STATE_STORE, ROCKSDB)


#: Errors wait in slices of this length; a slice is taken once the watermark has passed its end.
SLICE_US = MICROS


class ExpiringProcessor(StatefulProcessor):
    """Forgets a key once the watermark is past everything its state can still decide.

    With ``hold`` set, errors wait until the watermark has passed them, and are then taken in time order: whatever order
    they came in, the result is that of the batch. They wait as map entries by slice of time and number of the batch
    that brought them, so a batch writes what it brings and never what waits already, and a timer a slice takes one
    slice after the other. That is a call of the state store an error in the one task of a key; streams of this module
    wait in :func:`held` instead.
    """

    hold = False
    waiting_columns: list[str] = []

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.hold:
            self.waiting = handle.getMapState("waiting", "slice bigint, batch bigint", "rows string")
            self.marks = handle.getValueState("marks", "batches bigint, forget_ms bigint")

    def keep_until(self, us: int) -> None:
        if not self.hold:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((us + self.keep_us) // 1000 + 1)
            return
        # Timers of slices lie at whole seconds and a millisecond, this one at half a second: neither takes the other's.
        batches, before = self.marks.get() if self.marks.exists() else (0, None)
        wake = ((us + self.keep_us + SLICE_US) // MICROS + 1) * 1000 + 500
        if wake != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(wake)
            self.marks.update((batches, wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.hold:
            yield from self.take(key, pd.concat(list(rows)).sort_values(["us", "id"]))
            return
        batches, forget = self.marks.get() if self.marks.exists() else (0, None)
        for errors in rows:
            for number, part in errors.groupby(errors["us"] // SLICE_US):
                text = part[self.waiting_columns].to_json(orient="values", force_ascii=False)
                self.waiting.updateValue((int(number), batches), (text,))
                self.handle.registerTimer((int(number) + 1) * SLICE_US // 1000 + 1)
            batches += 1
        self.marks.update((batches, forget))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.hold:
            self.forget()
            return
        passed = sorted(tuple(at) for at in self.waiting.keys() if (at[0] + 1) * SLICE_US <= now * 1000)
        for _, entries in groupby(passed, key=lambda at: at[0]):
            entries = list(entries)
            rows = [row for at in entries for row in json.loads(self.waiting.getValue(at)[0])]
            errors = pd.DataFrame(rows, columns=self.waiting_columns).sort_values(["us", "id"])
            yield from self.take(key, errors.reset_index(drop=True))
            for at in entries:
                self.waiting.removeKey(at)
        batches, forget = self.marks.get() if self.marks.exists() else (0, None)
        if forget is not None and forget <= now:
            self.forget()
            self.marks.update((batches, None))
            if next(iter(self.waiting.keys()), None) is None:
                self.marks.clear()

    def close(self) -> None:
        pass


class BurstProcessor(ExpiringProcessor):
    """State of one scope: (start of the open window, errors in it, last alert). Three numbers,
    however many errors a scope has."""

    waiting_columns = ["scope", "id", "source", "content", "log_level", "us"]

    def __init__(self, threshold: int, window_us: int, cooldown_us: int, hold: bool = False):
        self.hold = hold
        self.threshold, self.window_us, self.cooldown_us = threshold, window_us, cooldown_us
        self.keep_us = max(window_us, cooldown_us)

    def forget(self) -> None:
        self.state.clear()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prepare(handle)
        self.state = handle.getValueState("burst", "anchor bigint, errors bigint, alerted bigint")

    def take(self, key, errors: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        anchor, count, alerted = known if known else (None, 0, None)
        fired = []
        for index, us in enumerate(errors["us"].tolist()):
            if anchor is not None and us < anchor:
                continue  # older than the open window
            if anchor is None or us - anchor > self.window_us:
                anchor, count = us, 1
                continue
            count += 1
            if count == self.threshold and (alerted is None or us - alerted > self.cooldown_us):
                alerted = us
                fired.append(index)
        self.state.update((anchor, count, alerted))
        self.keep_until(max(anchor, int(errors["us"].iloc[-1])))
        yield errors.iloc[fired].assign(scope=key[0])[BURST_COLUMNS]


class RepeatProcessor(ExpiringProcessor):
    """State of one (source, message): packed times of the errors in the trailing window, the newest
    logs in full, and the last report."""

    waiting_columns = ["id", "source", "content", "us"]

    def __init__(self, threshold: int, window_us: int, related: int, hold: bool = False):
        self.hold = hold
        self.threshold, self.window_us, self.related = threshold, window_us, related
        self.keep_us = window_us

    def forget(self) -> None:
        self.state.clear()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prepare(handle)
        self.state = handle.getValueState("repeats", "times binary, newest string, reported bigint")

    def take(self, key, errors: pd.DataFrame) -> Iterator[pd.DataFrame]:
        packed, newest, reported = self.state.get() if self.state.exists() else (b"", "[]", None)
        before = np.frombuffer(bytes(packed), dtype="<i8")
        if len(before):
            errors = errors[errors["us"] >= before[-1]]  # what is older has been counted or dropped
        if errors.empty:
            return
        times = np.concatenate([before, errors["us"].to_numpy(dtype="<i8")])
        # Full logs are known for the end of the old times and for all new ones.
        logs = json.loads(newest) + errors[LOG_COLUMNS].values.tolist()
        offset = len(times) - len(logs)
        repeats = np.arange(1, len(times) + 1) - np.searchsorted(times, times - self.window_us, "left")
        found = []
        for index in range(len(before), len(times)):
            us, count = int(times[index]), int(repeats[index])
            if count >= self.threshold and (reported is None or us - reported > self.window_us // 2):
                reported = us
                first = max(index - min(count, self.related) + 1, 0)
                found.append((count, [tuple(log) for log in reversed(logs[first - offset:index + 1 - offset])]))
        kept = times[np.searchsorted(times, times[-1] - self.window_us, "left"):]
        self.state.update((kept.tobytes(), json.dumps(logs[-self.related:]), reported))
        self.keep_until(int(times[-1]))
        yield pd.DataFrame(found, columns=["repeat_count", "logs"])


def held(errors: DataFrame) -> DataFrame:
    """``errors`` once the watermark has passed their slice of time, which is then their ``at``.

    Each distinct error is an aggregation group with a count: a batch writes only what it brings, the waiting errors of a
    hot key or second lie in all partitions, and none goes through Python before its time.
    """
    columns = [name for name in errors.columns if name != "at"]
    waiting = errors.groupBy(F.window("at", f"{SLICE_US} microseconds").alias("slice"), *columns)
    passed = waiting.agg(F.count("*").alias("copies"))
    return (passed.select(*columns, F.window_time("slice").alias("at"), F.explode(F.sequence(F.lit(1), "copies")))
            .drop("col"))


def stream_error_burst(logs: DataFrame, delay: str, threshold: int = BURST_THRESHOLD,
                       window_seconds: int = BURST_WINDOW_SECONDS,
                       cooldown_seconds: int = BURST_COOLDOWN_SECONDS,
                       scope: str | None = "source", hold: bool = False) -> DataFrame:
    """``error_burst`` on a stream: the errors that raise an alert, with their scope.

    At once, errors are taken in time order within a micro-batch, and one older than the open window is ignored.
    With ``hold`` they wait until the watermark has passed them: alerts come ``delay`` later, and none is missed
    or doubled when errors come out of order within the delay.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2: a window's first error never alerts")
    use_state_store(logs.sparkSession)
    created = F.col("created_at")
    scope_key = F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("all")
    errors = (logs.filter(is_error(F.col("log_level")))
              .select(scope_key.alias("scope"), "id", "source", "content", "log_level",
                      micros(created).alias("us"), instant(created).alias("at"))
              .withWatermark("at", delay))
    fired = (held(errors) if hold else errors).groupBy("scope").transformWithStateInPandas(
        BurstProcessor(threshold, window_seconds * MICROS, cooldown_seconds * MICROS),
        outputStructType="scope string, id bigint, source string, content string, log_level string, us bigint",
        outputMode="Append", timeMode="EventTime")
    return fired.withColumn("created_at", from_micros(F.col("us"))).drop("us")


def stream_repeated_error(logs: DataFrame, delay: str, threshold: int = REPEAT_THRESHOLD,
                          window_seconds: int = REPEAT_WINDOW_SECONDS,
                          prefix_chars: int = REPEAT_PREFIX_CHARS, related: int = REPEAT_RELATED_LOGS,
                          severity: str = "WARNING", hold: bool = False) -> DataFrame:
    """``repeated_error`` on a stream, in the same layout. ``hold``: see :func:`stream_error_burst`."""
    use_state_store(logs.sparkSession)
    created = F.col("created_at")
    prefix = normalize_message(F.col("content"), prefix_chars)
    errors = (logs.filter(is_exact_error(F.col("log_level")))
              .withColumn("prefix", prefix)
              .select(row_key("source", "prefix").alias("key"), "id", "source", "content",
                      micros(created).alias("us"), instant(created).alias("at"))
              .withWatermark("at", delay))
    found = (held(errors) if hold else errors).groupBy("key").transformWithStateInPandas(
        RepeatProcessor(threshold, window_seconds * MICROS, related),
        outputStructType="repeat_count bigint, "
                         "logs array<struct<id: bigint, source: string, content: string, us: bigint>>",
        outputMode="Append", timeMode="EventTime")
    full = F.transform("logs", lambda log: F.struct(
        log["id"].alias("id"), log["source"].alias("source"), log["content"].alias("content"),
        F.lit("ERROR").alias("log_level"), from_micros(log["us"]).alias("created_at")))
    return detection_rows(found.select("repeat_count", full.alias("related_logs"))
                          .withColumn("trigger_log", F.col("related_logs")[0]),
                          window_seconds, prefix_chars, severity)

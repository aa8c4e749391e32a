"""Error bursts and repeated errors over stored logs, and the plug-in interface for patterns."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.levels import is_error, is_exact_error, severity_rank
from emberlog.functions.text import (burst_message, normalize_message, pattern_subject,
                                     repeat_message)
from emberlog.functions.times import MICROS, instant, micros, wall_time
from emberlog.operators.ordered import (BLOCK, KEY, TIME, anchored_nth, range_ordered, row_key,
                                        running_total)
from emberlog.schemas import (ALERT_SCHEMA, BURST_COOLDOWN_SECONDS, BURST_THRESHOLD,
                              BURST_WINDOW_SECONDS, PATTERN_RESULT_SCHEMA, REPEAT_PREFIX_CHARS,
                              REPEAT_RELATED_LOGS, REPEAT_THRESHOLD, REPEAT_WINDOW_SECONDS,
                              SEVERITIES)
from emberlog.session import materialize

LOG_COLUMNS = ("id", "source", "content", "log_level", "created_at")


def error_burst(logs: DataFrame, threshold: int = BURST_THRESHOLD,
                window_seconds: int = BURST_WINDOW_SECONDS,
                cooldown_seconds: int = BURST_COOLDOWN_SECONDS,
                scope: str | None = "source") -> DataFrame:
    """Errors that complete a burst: the ``threshold``-th error of an anchored window, unless an
    alert of the same scope lies at most ``cooldown_seconds`` back.

    ``scope=None`` counts all sources together. Returns the triggering logs with their ``scope``.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2: a window's first error never alerts")
    scope_key = F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("all")
    errors = (logs.filter(is_error(F.col("log_level")))
              .select(*LOG_COLUMNS, scope_key.alias(KEY), micros(F.col("created_at")).alias(TIME)))
    # Rows carry their logs along: no id has to be unique to find them again.
    full = anchored_nth(range_ordered(errors, TIME, "id"), window_seconds * MICROS, threshold)
    alerts = anchored_nth(range_ordered(full.drop(BLOCK), TIME, "id"), cooldown_seconds * MICROS, 1)
    return alerts.select(F.col(KEY).alias("scope"), *LOG_COLUMNS)


def burst_alerts(bursts: DataFrame, threshold: int = BURST_THRESHOLD,
                 window_seconds: int = BURST_WINDOW_SECONDS) -> DataFrame:
    """Burst triggers as rows of the alert table."""
    return bursts.select(
        F.col("created_at").alias("alert_ts"), F.lit("error-burst").alias("kind"),
        F.lit("ERROR").alias("severity"), F.lit("Error burst detected").alias("subject"),
        burst_message(threshold, window_seconds, F.col("source"), F.col("content")).alias("message"))


def windowed_burst(logs: DataFrame, window: str, threshold: int, slide: str | None = None,
                   scope: str = "source", watermark: str | None = None) -> DataFrame:
    """Fixed windows with at least ``threshold`` errors per scope; works on batches and streams."""
    errors = logs.filter(is_error(F.col("log_level"))).select(
        scope, instant(F.col("created_at")).alias("at"))
    if watermark:
        errors = errors.withWatermark("at", watermark)
    spans = F.window("at", window, slide) if slide else F.window("at", window)
    return (errors.groupBy(spans.alias("span"), F.col(scope).alias("scope"))
            .agg(F.count("*").alias("errors"))
            .filter(F.col("errors") >= threshold)
            .select("scope", wall_time(F.col("span.start")).alias("window_start"),
                    wall_time(F.col("span.end")).alias("window_end"), "errors"))


def _repeat_rows(logs: DataFrame, prefix_chars: int) -> DataFrame:
    return (logs.filter(is_exact_error(F.col("log_level")))
            .select(*LOG_COLUMNS, normalize_message(F.col("content"), prefix_chars).alias("message_pattern"),
                    micros(F.col("created_at")).alias(TIME))
            .withColumn(KEY, row_key("source", "message_pattern")))


def repeated_error_counts(logs: DataFrame, window_seconds: int = REPEAT_WINDOW_SECONDS,
                          prefix_chars: int = REPEAT_PREFIX_CHARS) -> DataFrame:
    """Every error with its position among the similar errors of the trailing window, and in all.

    Rows are numbered in the order of the written sort, so errors with equal ids count each. Each error also asks how many similar errors came before its window. Questions and errors are
    sorted together, so the answer is a difference of two running totals and no window frame has to
    hold a key's rows.
    """
    errors = (range_ordered(_repeat_rows(logs, prefix_chars), TIME, "id").drop(BLOCK)
              .withColumn("line", F.monotonically_increasing_id()))
    steps = errors.select(
        "line", KEY, F.explode(F.array(
            F.struct((F.col(TIME) - window_seconds * MICROS).alias(TIME), F.lit(0).alias("step")),
            F.struct(F.col(TIME).alias(TIME), F.lit(1).alias("step")))).alias("at"))
    steps = steps.select("line", KEY, F.col(f"at.{TIME}").alias(TIME), F.col("at.step").alias("step"))
    order = (TIME, "step", "line")
    counted = running_total(range_ordered(steps, *order), "step", "seen", *order)
    asked = F.col("step") == 0
    answers = counted.groupBy("line").agg(
        (F.max(F.when(~asked, F.col("seen"))) - F.max(F.when(asked, F.col("seen")))).alias("repeat_count"),
        F.max(F.when(~asked, F.col("seen"))).alias("position"))
    return errors.join(answers, "line")


def repeated_error_candidates(logs: DataFrame, threshold: int = REPEAT_THRESHOLD,
                              window_seconds: int = REPEAT_WINDOW_SECONDS,
                              prefix_chars: int = REPEAT_PREFIX_CHARS) -> DataFrame:
    """Errors that are at least the ``threshold``-th similar one within the trailing window."""
    counts = repeated_error_counts(logs, window_seconds, prefix_chars)
    return counts.filter(F.col("repeat_count") >= threshold).select(
        "id", "source", "message_pattern", "created_at", "repeat_count")


def repeated_error(logs: DataFrame, threshold: int = REPEAT_THRESHOLD,
                   window_seconds: int = REPEAT_WINDOW_SECONDS,
                   prefix_chars: int = REPEAT_PREFIX_CHARS, related: int = REPEAT_RELATED_LOGS,
                   severity: str = "WARNING") -> DataFrame:
    """Detections of repeated errors: candidates, each more than half a window after the one
    reported before for the same source and message. One row per detection, with its newest logs."""
    # Every error with its position in its key; the positions also address the related logs.
    counts = materialize(repeated_error_counts(logs, window_seconds, prefix_chars))
    spaced = anchored_nth(
        range_ordered(counts.filter(F.col("repeat_count") >= threshold).select(
            KEY, TIME, "line", "position", "repeat_count"), TIME, "line"),
        window_seconds * MICROS // 2, 1)
    detections = spaced.select(F.col("line").alias("trigger"), KEY, "position", "repeat_count")
    # At most ``related`` positions a detection, so the join keys are unique and evenly spread.
    newest = detections.select(
        "trigger", "repeat_count", KEY,
        F.explode(F.sequence(F.col("position") - F.least(F.lit(related), F.col("repeat_count")) + 1,
                             F.col("position"))).alias("position"))
    members = newest.join(counts.select(KEY, "position", *LOG_COLUMNS), [KEY, "position"])
    log = F.struct(*LOG_COLUMNS)
    detected = (members.groupBy("trigger", "repeat_count")
                .agg(F.max_by(log, "position").alias("trigger_log"),
                     F.reverse(F.array_sort(F.collect_list(F.struct("position", log.alias("log")))))
                     .alias("found")))
    listed = detected.withColumn("related_logs", F.transform("found", lambda item: item["log"]))
    return detection_rows(listed, window_seconds, prefix_chars, severity)


def detection_rows(found: DataFrame, window_seconds: int, prefix_chars: int, severity: str) -> DataFrame:
    """Pattern results from (``repeat_count``, ``trigger_log``, ``related_logs``)."""
    pattern = normalize_message(F.col("trigger_log.content"), prefix_chars)
    return found.select(
        F.lit("repeated-error").alias("pattern_id"), F.lit("Repeated error").alias("pattern_name"),
        F.lit(True).alias("detected"), F.lit(severity).alias("severity"),
        repeat_message(F.col("trigger_log.source"), window_seconds, F.col("repeat_count"),
                       F.col("trigger_log.content")).alias("message"),
        F.col("trigger_log.created_at").alias("detected_at"), "trigger_log", "related_logs",
        F.struct(F.col("trigger_log.source").alias("source"), pattern.alias("message_pattern"),
                 F.col("repeat_count").cast("long").alias("repeat_count"),
                 F.lit(window_seconds).cast("long").alias("time_window_seconds"))
        .alias("additional_data"))


class Pattern(Protocol):
    """A log pattern. ``detect`` turns logs into rows of the pattern-result layout."""

    pattern_id: str
    name: str
    description: str
    severity: str
    enabled: bool

    def detect(self, logs: DataFrame) -> DataFrame: ...


class RepeatedErrorPattern:
    """``repeated_error`` as a plug-in."""

    pattern_id = "repeated-error"
    name = "Repeated error"
    description = "The same error text of one source several times within a short time."

    def __init__(self, threshold: int = REPEAT_THRESHOLD,
                 window_seconds: int = REPEAT_WINDOW_SECONDS, severity: str = "WARNING",
                 enabled: bool = True):
        self.threshold, self.window_seconds = threshold, window_seconds
        self.severity, self.enabled = severity, enabled

    def detect(self, logs: DataFrame) -> DataFrame:
        return repeated_error(logs, self.threshold, self.window_seconds, severity=self.severity)


def _warn(pattern: Pattern, error: Exception) -> None:
    warnings.warn(f"pattern {pattern.pattern_id} skipped: {error}", stacklevel=2)


def detect_patterns(logs: DataFrame, patterns: list[Pattern],
                    on_failure: Callable = _warn) -> DataFrame:
    """Detections of all enabled patterns. Each pattern runs and is written alone: one that fails, while
    it is planned or while it runs, is reported to ``on_failure(pattern, error)`` and does not stop the others."""
    found = []
    for pattern in patterns:
        if not pattern.enabled:
            continue
        try:
            found.append(materialize(pattern.detect(logs)))
        except Exception as error:  # noqa: BLE001 - a plug-in may raise anything
            on_failure(pattern, error)
    merged = logs.sparkSession.createDataFrame([], PATTERN_RESULT_SCHEMA)
    for detections in found:
        merged = merged.unionByName(detections)
    return merged


def pattern_alerts(detections: DataFrame, least: str = "WARNING") -> DataFrame:
    """Detections of at least severity ``least`` as rows of the alert table."""
    serious = severity_rank(F.col("severity")) >= SEVERITIES.index(least)
    return detections.filter(serious).select(
        F.col("detected_at").alias("alert_ts"), F.col("pattern_id").alias("kind"), "severity",
        pattern_subject(F.col("pattern_name")).alias("subject"), "message"
    ).select(*ALERT_SCHEMA.names)


def running_count(logs: DataFrame) -> DataFrame:
    """Position of every log among those of its source and level, in time order."""
    rows = logs.select("id", "source", "log_level", F.lit(1).alias("one"),
                       row_key("source", "log_level").alias(KEY),
                       micros(F.col("created_at")).alias(TIME))
    counted = running_total(range_ordered(rows, TIME, "id"), "one", "running_count", TIME, "id")
    return counted.select("id", "source", "log_level", "running_count")

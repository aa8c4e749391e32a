"""All streams of a log service, each with its own checkpoint below one folder."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.ingest import normalize_events, with_event_id
from emberlog.operators.metrics import streaming_minute_metrics
from emberlog.operators.patterns import burst_alerts, pattern_alerts
from emberlog.schemas import BURST_THRESHOLD, BURST_WINDOW_SECONDS
from emberlog.sinks.tables import write_alerts
from emberlog.sources.events import decode_events
from emberlog.streaming.consume import consume_events, emit_alerts
from emberlog.streaming.detectors import stream_error_burst, stream_repeated_error, use_state_store


class StreamPattern(Protocol):
    """A log pattern on a stream.

    ``detect_stream`` turns streamed logs (``id``, ``source``, ``content``, ``log_level``, ``created_at``) into rows of the
    pattern-result layout. It may keep state of its own, for example in a ``StatefulProcessor`` with its own schema:
    every pattern runs as a query with a checkpoint of its own.
    """

    pattern_id: str
    name: str
    description: str
    severity: str
    enabled: bool

    def detect_stream(self, logs: DataFrame, delay: str) -> DataFrame: ...


def event_logs(messages: DataFrame, as_of: datetime | str | Callable[[int], datetime]) -> DataFrame:
    """Messages as readable logs with stable ids, for detectors and metrics.

    Where ``as_of`` is a function, events without any time get that of their micro-batch, which Spark records, so that
    a retry agrees."""
    now = F.current_timestamp().cast("timestamp_ntz") if callable(as_of) else as_of
    events = normalize_events(with_event_id(decode_events(messages)), now)
    return events.select("id", "source", "content", F.col("logLevel").alias("log_level"),
                         F.col("timestamp").alias("created_at"))


def _warn(pattern: StreamPattern, error: Exception) -> None:
    warnings.warn(f"pattern {pattern.pattern_id} was not started: {error}", stacklevel=3)


def start_patterns(logs: DataFrame, root: str, patterns: Sequence[StreamPattern], delay: str = "1 minute",
                   on_failure: Callable[[StreamPattern, Exception], object] = _warn,
                   **trigger) -> dict[str, StreamingQuery]:
    """Start every enabled pattern as a query of its own into the alert table below ``root``; by pattern id.

    A pattern that fails while it is planned goes to ``on_failure`` and stops no other; one that fails while it runs
    fails its own query and resumes from its own checkpoint. Ids must differ, as checkpoints are named by them."""
    ids = [pattern.pattern_id for pattern in patterns]
    if len(set(ids)) < len(ids):
        raise ValueError(f"pattern ids must differ: {sorted(ids)}")
    use_state_store(logs.sparkSession)
    started = {}
    for pattern in patterns:
        if not pattern.enabled:
            continue
        name = f"pattern-{pattern.pattern_id}"
        try:
            alerts = pattern_alerts(pattern.detect_stream(logs, delay))
            started[pattern.pattern_id] = emit_alerts(alerts, _alert_table(root, name), f"{root}/state/{name}", **trigger)
        except Exception as error:  # noqa: BLE001 - a plug-in may raise anything
            on_failure(pattern, error)
    return started


def _alert_table(root: str, name: str) -> Callable[[DataFrame, str], object]:
    return lambda batch, load: write_alerts(batch, f"{root}/alerts", f"{name}-{load}")


def start_service(messages: DataFrame, root: str, as_of: datetime | str | Callable[[int], datetime],
                  delay: str = "1 minute", with_index: bool = False, threshold: int = BURST_THRESHOLD,
                  window_seconds: int = BURST_WINDOW_SECONDS, hold: bool = False,
                  patterns: Sequence[StreamPattern] = (),
                  on_failure: Callable[[StreamPattern, Exception], object] = _warn,
                  **trigger) -> dict[str, StreamingQuery]:
    """Start storage, burst alerts, repeated-error alerts and minute metrics on one message stream.

    ``hold`` makes detectors wait for late errors: set it where partitions interleave. ``as_of`` is the time of events
    that have none, see :func:`consume_events` and :func:`event_logs`. ``patterns`` are started beside the two
    detectors and returned as ``pattern-<id>``, see :func:`start_patterns`."""
    logs = event_logs(messages, as_of)

    bursts = burst_alerts(stream_error_burst(logs, delay, threshold, window_seconds, hold=hold), threshold, window_seconds)
    repeats = pattern_alerts(stream_repeated_error(logs, delay, hold=hold))
    minutes = streaming_minute_metrics(logs, delay)
    own = start_patterns(logs, root, patterns, delay, on_failure, **trigger)
    return {
        "store": consume_events(messages, root, f"{root}/state/store", as_of, with_index, **trigger),
        "bursts": emit_alerts(bursts, _alert_table(root, "burst"), f"{root}/state/bursts", **trigger),
        "repeats": emit_alerts(repeats, _alert_table(root, "repeat"), f"{root}/state/repeats", **trigger),
        "minutes": (minutes.writeStream.format("parquet").option("path", f"{root}/minutes")
                    .option("checkpointLocation", f"{root}/state/minutes").outputMode("append")
                    .trigger(**(trigger or {"processingTime": "1 minute"})).start()),
        **{f"pattern-{name}": query for name, query in own.items()},
    }

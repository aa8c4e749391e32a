"""Row-wise steps between an incoming event and a stored log. Same code for batch and stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.compression import compress, should_compress
from emberlog.functions.levels import known_level, levels_from
from emberlog.functions.measures import original_size
from emberlog.functions.text import unless_blank
from emberlog.functions.times import at, instant, log_date
from emberlog.schemas import (BYPASS_SOURCE, DEFAULT_LEVEL, DEFAULT_SOURCE, LEVELS,
                              MIN_COMPRESS_CHARS)


def normalize_events(events: DataFrame, as_of: datetime | str) -> DataFrame:
    """Fill a missing time, level or source; values that are there stay as they are."""
    return events.withColumns({
        "timestamp": F.coalesce(F.col("timestamp"), at(as_of)),
        "logLevel": unless_blank(F.col("logLevel"), DEFAULT_LEVEL),
        "source": unless_blank(F.col("source"), DEFAULT_SOURCE),
    })


def route_by_level(events: DataFrame, level: str = "logLevel") -> DataFrame:
    """Channel of each event in ``route``: its known level, INFO for any other."""
    return events.withColumn("route", known_level(F.col(level)))


def route_split(events: DataFrame) -> dict[str, DataFrame]:
    """The four channels as filtered views of one routed frame."""
    routed = events if "route" in events.columns else route_by_level(events)
    return {level: routed.filter(F.col("route") == level) for level in LEVELS}


def enrich_events(events: DataFrame, as_of: datetime | str) -> DataFrame:
    """Processing time, channel, and an id derived from the event, equal on every retry."""
    routed = events if "route" in events.columns else route_by_level(events)
    identity = F.sha2(F.to_json(F.struct("source", "content", "logLevel", "timestamp")), 256)
    return routed.withColumns({
        "timestamp": F.coalesce(F.col("timestamp"), at(as_of)),
        "processed_time": at(as_of),
        "correlation_id": identity,
    })


def filter_events(events: DataFrame, min_level: str = DEFAULT_LEVEL, excluded_sources: str = "",
                  source: str = "source", level: str = "logLevel") -> DataFrame:
    """Keep events of at least ``min_level`` whose source is not excluded.

    ``excluded_sources`` is a comma list compared exactly, blanks included. One source used for
    performance tests always passes.
    """
    passing = levels_from(min_level)
    keep = F.lit(True) if passing is None else F.upper(level).isin(*passing)
    if excluded_sources:
        excluded = F.coalesce(F.col(source).isin(*excluded_sources.split(",")), F.lit(False))
        keep = ~excluded & keep
    return events.filter(keep | (F.col(source) == BYPASS_SOURCE))


def ingest_events(events: DataFrame, as_of: datetime | str, min_level: str | None = DEFAULT_LEVEL,
                  excluded_sources: str = "") -> DataFrame:
    """Defaults, routing, enrichment and filter in one narrow plan. ``min_level=None``: no filter."""
    enriched = enrich_events(route_by_level(normalize_events(events, as_of)), as_of)
    return enriched if min_level is None else filter_events(enriched, min_level, excluded_sources)


def append_sources(*sources: DataFrame) -> DataFrame:
    """Events of several collectors as one frame; columns one of them lacks become null."""
    merged = sources[0]
    for source in sources[1:]:
        merged = merged.unionByName(source, allowMissingColumns=True)
    return merged


def with_event_id(events: DataFrame) -> DataFrame:
    """A 64-bit id from the ``position`` of its message where the source tells it, so that equal events
    stay apart; else from the event itself. A retried delivery gets the same id. Take ids before defaults."""
    key = ["position"] if "position" in events.columns else ["source", "content", "logLevel", "timestamp"]
    return events.withColumn("id", F.xxhash64(*key))


def dedup_events(events: DataFrame, key: str = "id", delay: str | None = None,
                 event_time: str = "timestamp") -> DataFrame:
    """One row per ``key``. On a stream, pass the watermark ``delay``: state older than it is dropped."""
    if events.isStreaming:
        return (events.withColumn("_at", instant(F.col(event_time)))
                .withWatermark("_at", delay or "10 minutes")
                .dropDuplicatesWithinWatermark([key]).drop("_at"))
    return events.dropDuplicates([key])


def to_log_rows(events: DataFrame, as_of: datetime | str, min_chars: int = MIN_COMPRESS_CHARS,
                enabled: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events with an ``id`` as rows of the log table: sizes taken, long bodies compressed."""
    body = F.col("content")
    rows = events.select(
        "id", "source", body, F.col("logLevel").alias("log_level"),
        F.coalesce(F.col("timestamp"), at(as_of)).alias("created_at"),
        should_compress(body, min_chars, enabled).alias("compressed"),
        original_size(body).alias("original_size"), *keep)
    return stored_sizes(rows.withColumn("content", compress(body, F.col("compressed"))))


def stored_sizes(rows: DataFrame) -> DataFrame:
    """Stored size next to the original one, and the day that partitions the table."""
    return rows.withColumns({
        "compressed_size": F.when(F.col("compressed"), original_size(F.col("content")))
        .otherwise(F.col("original_size")),
        "log_date": log_date(F.col("created_at")),
    })

"""Table layouts and level constants shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The four known levels, highest rank first, and what each one ranks.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG")
LEVEL_RANKS = {"ERROR": 4, "WARN": 3, "INFO": 2, "DEBUG": 1}
DEFAULT_LEVEL = "INFO"
DEFAULT_SOURCE = "unknown"
BYPASS_SOURCE = "performance-test"

# Detection severities, lowest first.
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")

# Service defaults (sizes in characters, times in the unit named).
MIN_COMPRESS_CHARS = 1024
ARCHIVE_DAYS = 30
RETENTION_DAYS = 90
BURST_THRESHOLD = 10
BURST_WINDOW_SECONDS = 60
BURST_COOLDOWN_SECONDS = 300
REPEAT_THRESHOLD = 3
REPEAT_WINDOW_SECONDS = 300
REPEAT_PREFIX_CHARS = 30
REPEAT_RELATED_LOGS = 10
PAGE_SIZE = 20
RECENT_ERRORS = 5
LOCAL_ZONE = "Asia/Seoul"

EVENT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("logLevel", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

LOGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("log_level", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("compressed", T.BooleanType()),
    T.StructField("original_size", T.IntegerType()),
    T.StructField("compressed_size", T.IntegerType()),
])

ARCHIVE_SCHEMA = T.StructType(
    LOGS_SCHEMA.fields + [T.StructField("archived_at", T.TimestampNTZType())])

STATISTICS_KEYS = ("log_date", "hour", "source", "log_level")

STATISTICS_SCHEMA = T.StructType([
    T.StructField("log_date", T.DateType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("log_level", T.StringType()),
    T.StructField("count", T.LongType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("alert_ts", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("message", T.StringType()),
])

DETECTION_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("log_level", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

PATTERN_RESULT_SCHEMA = T.StructType([
    T.StructField("pattern_id", T.StringType()),
    T.StructField("pattern_name", T.StringType()),
    T.StructField("detected", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("detected_at", T.TimestampNTZType()),
    T.StructField("trigger_log", DETECTION_LOG),
    T.StructField("related_logs", T.ArrayType(DETECTION_LOG)),
    T.StructField("additional_data", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("message_pattern", T.StringType()),
        T.StructField("repeat_count", T.LongType()),
        T.StructField("time_window_seconds", T.LongType()),
    ])),
])

"""Log tables: adapters over event and document tables, and pruned reads of stored logs."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.times import at, day_bounds, on, parse
from emberlog.schemas import ARCHIVE_DAYS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def logs_from_events(events: DataFrame) -> DataFrame:
    """Event rows as log rows. One event type carries a level no rule knows, on purpose."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("source"),
        F.concat(kind, F.lit(" event while handling request: "), F.col("props")).alias("content"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN")
        .when(kind == "click", "DEBUG").when(kind == "signup", "trace")
        .otherwise("INFO").alias("log_level"),
        F.col("ts").alias("created_at"))


def logs_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as long log bodies, one a minute over 30 days."""
    slot = F.col("doc_id") % 20
    minutes = (F.col("doc_id") % 43200).cast("int")
    return documents.select(
        F.col("doc_id").alias("id"), F.col("source"), F.col("text").alias("content"),
        F.when(slot == 0, "ERROR").when(slot <= 3, "WARN")
        .when(slot <= 15, "INFO").otherwise("DEBUG").alias("log_level"),
        (at("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), minutes))
        .alias("created_at"))


def between_dates(logs: DataFrame, first: date, last: date) -> DataFrame:
    """Partition pruning: bounds on ``log_date``, where the frame has that column."""
    if "log_date" not in logs.columns:
        return logs
    return logs.filter(F.col("log_date").between(on(first), on(last)))


def between_closed(logs: DataFrame, start: datetime | str, end: datetime | str,
                   column: str = "created_at") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    pruned = between_dates(logs, parse(start).date(), parse(end).date())
    return pruned.filter(F.col(column).between(at(start), at(end)))


def scan_old_logs(logs: DataFrame, as_of: datetime | str, days: int = ARCHIVE_DAYS) -> DataFrame:
    """Rows strictly older than ``days`` before ``as_of``."""
    cutoff = parse(as_of) - timedelta(days=days)
    if "log_date" in logs.columns:
        logs = logs.filter(F.col("log_date") <= on(cutoff.date()))
    return logs.filter(F.col("created_at") < at(cutoff))


def scan_day_logs(logs: DataFrame, day: date | str, closed: bool = False) -> DataFrame:
    """Rows of one day. ``closed`` adds rows stamped exactly at the next midnight."""
    start, end = day_bounds(day)
    if closed:
        return between_closed(logs, start, end)
    pruned = between_dates(logs, start.date(), start.date())
    return pruned.filter((F.col("created_at") >= at(start)) & (F.col("created_at") < at(end)))


def find_by_id(logs: DataFrame, log_id: int) -> DataFrame:
    return logs.filter(F.col("id") == F.lit(log_id))


def count_all(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"))

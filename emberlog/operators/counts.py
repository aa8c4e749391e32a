"""Dashboard panels: counts by level, hour, source and day, from raw logs or from the rollup."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.compression import decompress
from emberlog.functions.levels import known_level
from emberlog.functions.measures import error_rate, percent
from emberlog.functions.times import (at, at_midnight, day_bounds, hour_label, log_date, log_hour, on,
                                     on_the_hour, parse)
from emberlog.schemas import LEVELS, RECENT_ERRORS
from emberlog.sources.tables import between_closed, scan_day_logs

LEVEL_COLUMNS = {level: level.lower() for level in LEVELS}


def _level_counts(level: Column) -> list[Column]:
    return [F.count_if(level == name).alias(column) for name, column in LEVEL_COLUMNS.items()]


def _level_sums(level: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(level == name, F.col("count"))), F.lit(0)).alias(column)
            for name, column in LEVEL_COLUMNS.items()]


def _zero_filled(spine: DataFrame, counted: DataFrame, on_column: str) -> DataFrame:
    """One row per bucket of ``spine``. ``counted`` is grouped by the same bucket, so both are small."""
    values = [c for c in counted.columns if c != on_column]
    return spine.join(counted, on_column, "left").select(
        on_column, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in values])


def hour_spine(logs: DataFrame) -> DataFrame:
    return logs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))


def day_spine(logs: DataFrame, first: date, last: date) -> DataFrame:
    days = logs.sparkSession.range(1).select(
        F.explode(F.sequence(on(first), on(last))).alias("log_date"))
    return days


def log_counts(logs: DataFrame, start: datetime | str, end: datetime | str,
               source: str | None = None) -> DataFrame:
    """Counts per level, in all, and the error rate. The total includes unknown levels."""
    rows = between_closed(logs, start, end)
    if source:
        rows = rows.filter(F.col("source").contains(source))
    counted = rows.agg(*_level_counts(F.col("log_level")), F.count("*").alias("total"))
    return counted.withColumn("error_rate", error_rate(F.col("error"), F.col("total")))


def stats_between(stats: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rollup rows of the whole days from ``start`` to ``end``."""
    return stats.filter(F.col("log_date").between(on(parse(start).date()), on(parse(end).date())))


def log_counts_rollup(stats: DataFrame, start: datetime | str, end: datetime | str,
                      source: str | None = None) -> DataFrame:
    """``log_counts`` from the rollup, over whole days and with levels in any case."""
    rows = stats_between(stats, start, end)
    if source:
        rows = rows.filter(F.col("source").contains(source))
    counted = rows.agg(*_level_sums(F.upper("log_level")),
                       F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return counted.withColumn("error_rate", error_rate(F.col("error"), F.col("total")))


def hourly_stats(logs: DataFrame, day: date | str, closed: bool = False) -> DataFrame:
    """24 rows of counts per known level; the total counts the known levels only.

    ``closed`` counts a row stamped exactly on the hour in the hour before as well.
    """
    created = F.col("created_at")
    rows = scan_day_logs(logs, day, closed=closed)
    if closed:
        start, end = day_bounds(day)
        own = F.when(created < at(end), log_hour(created))
        before = F.when(on_the_hour(created) & (created > at(start)), ((log_hour(created) + 23) % 24).cast("int"))
        hours = F.filter(F.array(own, before), lambda hour: hour.isNotNull())
        rows = rows.select("log_level", F.explode(hours).alias("hour"))
    else:
        rows = rows.select("log_level", log_hour(created).alias("hour"))
    counted = rows.groupBy("hour").agg(*_level_counts(F.col("log_level")))
    filled = _zero_filled(hour_spine(logs), counted, "hour")
    total = sum((F.col(c) for c in LEVEL_COLUMNS.values()), F.lit(0))
    return filled.select(hour_label(F.col("hour")).alias("hour"), *LEVEL_COLUMNS.values(),
                         total.cast("long").alias("total"))


def hourly_stats_rollup(stats: DataFrame, day: date | str) -> DataFrame:
    """24 rows from the rollup; the total counts every level."""
    counted = (stats.filter(F.col("log_date") == on(day)).groupBy("hour")
               .agg(*_level_sums(F.col("log_level")), F.sum("count").alias("total")))
    filled = _zero_filled(hour_spine(stats), counted, "hour")
    return filled.withColumn("hour", hour_label(F.col("hour")))


def counted_levels(counts: DataFrame) -> DataFrame:
    """``log_counts`` of rows (log_level, count)."""
    summed = counts.agg(*_level_sums(F.col("log_level")), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return summed.withColumn("error_rate", error_rate(F.col("error"), F.col("total")))


def counted_hours(counts: DataFrame, day: date | str) -> DataFrame:
    """``hourly_stats`` of rows (log_date, hour, log_level, count)."""
    summed = counts.filter(F.col("log_date") == on(day)).groupBy("hour").agg(*_level_sums(F.col("log_level")))
    filled = _zero_filled(hour_spine(counts), summed, "hour")
    total = sum((F.col(c) for c in LEVEL_COLUMNS.values()), F.lit(0))
    return filled.select(hour_label(F.col("hour")).alias("hour"), *LEVEL_COLUMNS.values(),
                         total.cast("long").alias("total"))


def counted_trends(counts: DataFrame, first: date, last: date) -> DataFrame:
    """``error_trends`` of rows (log_date, log_level, count)."""
    errors = F.sum(F.when(F.col("log_level") == "ERROR", F.col("count")))
    summed = counts.groupBy("log_date").agg(
        F.sum("count").alias("total_logs"), F.coalesce(errors, F.lit(0)).alias("error_logs"))
    filled = _zero_filled(day_spine(counts, first, last), summed, "log_date")
    return filled.withColumn("error_rate", error_rate(F.col("error_logs"), F.col("total_logs")))


def source_stats(logs: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Logs per source, most first."""
    return (between_closed(logs, start, end).groupBy("source").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "source"))


def source_stats_rollup(stats: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    return (stats_between(stats, start, end).groupBy("source").agg(F.sum("count").alias("count"))
            .orderBy(F.desc("count"), "source"))


def top_sources(stats: DataFrame, start: datetime | str, end: datetime | str,
                limit: int = 10) -> DataFrame:
    return source_stats_rollup(stats, start, end).limit(limit)


def level_stats_rollup(stats: DataFrame, start: datetime | str, end: datetime | str,
                       source: str | None = None) -> DataFrame:
    rows = stats_between(stats, start, end)
    if source:
        rows = rows.filter(F.col("source").contains(source))
    return rows.groupBy("log_level").agg(F.sum("count").alias("count"))


def source_level_stats(stats: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """One row per source with its counts per known level and in all."""
    return (stats_between(stats, start, end).groupBy("source")
            .agg(*_level_sums(F.upper("log_level")), F.sum("count").alias("total")))


def error_trends(logs: DataFrame, start: datetime | str, end: datetime | str,
                 closed: bool = False) -> DataFrame:
    """One row per day from ``start`` to ``end`` with total, errors and error rate.

    ``closed`` counts a row stamped exactly at midnight in the day before as well.
    """
    first, last = parse(start).date(), parse(end).date()
    lower, upper = day_bounds(first)[0], day_bounds(last)[1]
    created = F.col("created_at")
    rows = between_closed(logs, lower, upper)
    if not closed:
        rows = rows.filter(created < at(upper))
    own = log_date(created)
    days = F.array(own)
    if closed:
        days = F.when(at_midnight(created), F.array(own, F.date_sub(own, 1))).otherwise(days)
    counted = (rows.select("log_level", F.explode(days).alias("log_date")).groupBy("log_date")
               .agg(F.count("*").alias("total_logs"),
                    F.count_if(F.col("log_level") == "ERROR").alias("error_logs")))
    filled = _zero_filled(day_spine(logs, first, last), counted, "log_date")
    return filled.withColumn("error_rate", error_rate(F.col("error_logs"), F.col("total_logs")))


def level_counters(logs: DataFrame) -> DataFrame:
    """Processed logs per known level, unknown levels counted as INFO, and in all."""
    per_level = logs.groupBy(known_level(F.col("log_level")).alias("level")).agg(
        F.count("*").alias("processed"))
    return per_level.rollup("level").agg(F.sum("processed").alias("processed")).select(
        F.coalesce("level", F.lit("TOTAL")).alias("level"),
        F.coalesce("processed", F.lit(0)).alias("processed"))


def level_share(counts: DataFrame) -> DataFrame:
    """Slices of the level chart from a ``log_counts`` row: value and whole percent, none empty."""
    pairs = [item for name, column in LEVEL_COLUMNS.items() for item in (F.lit(name), F.col(column))]
    known = sum((F.col(c) for c in LEVEL_COLUMNS.values()), F.lit(0))
    slices = counts.select("*", known.alias("known")).select(
        F.stack(F.lit(len(LEVELS)), *pairs).alias("level", "value"), "known")
    return slices.filter(F.col("value") > 0).select(
        "level", "value",
        F.floor(percent(F.col("value"), F.col("known")) + 0.5).cast("int").alias("percent"))


def streaming_level_counters(logs: DataFrame) -> DataFrame:
    """``level_counters`` of a stream, without the total; run it in complete mode."""
    return logs.groupBy(known_level(F.col("log_level")).alias("level")).agg(F.count("*").alias("processed"))


def distinct_sources(logs: DataFrame) -> DataFrame:
    return logs.select("source").distinct()


def recent_errors(logs: DataFrame, limit: int = RECENT_ERRORS) -> DataFrame:
    """The newest logs of level ERROR; stored bodies are made readable after the cut."""
    newest = (logs.filter(F.col("log_level") == "ERROR")
              .orderBy(F.desc("created_at"), F.desc("id")).limit(limit))
    if "compressed" not in logs.columns:
        return newest
    return newest.withColumn("content", decompress(F.col("content"), F.col("compressed")))

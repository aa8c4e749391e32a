"""The hourly statistics rollup: build, merge, rebuild, reconcile."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.times import instant, log_date, log_hour, wall_time
from emberlog.schemas import STATISTICS_KEYS
from emberlog.sources.tables import scan_day_logs

KEYS = list(STATISTICS_KEYS)


def hourly_rollup(logs: DataFrame) -> DataFrame:
    """Logs per day, hour, source and level."""
    return (logs.groupBy(log_date(F.col("created_at")).alias("log_date"),
                         log_hour(F.col("created_at")).alias("hour"), "source", "log_level")
            .agg(F.count("*").alias("count")))


def increment_statistics(logs: DataFrame) -> DataFrame:
    """Rollup rows of events that have a source, a level and a time; others are left out."""
    return hourly_rollup(logs.dropna(subset=["source", "log_level", "created_at"]))


def upsert_statistics(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """Rollup after adding ``delta``: equal keys are summed, null keys count as equal."""
    merged = stats.select(*KEYS, "count").unionByName(delta.select(*KEYS, "count"))
    return merged.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def rebuild_daily_statistics(logs: DataFrame, day: date | str) -> DataFrame:
    """The rollup of one day, from its raw logs alone."""
    return hourly_rollup(scan_day_logs(logs, day))


def reconcile_statistics(stats: DataFrame, logs: DataFrame) -> DataFrame:
    """Rollup against raw logs, one row per key: match, missing, extra or diff."""
    tagged = (stats.select(*KEYS, F.col("count").alias("rollup_count"),
                           F.lit(None).cast("long").alias("raw_count"))
              .unionByName(hourly_rollup(logs).select(
                  *KEYS, F.lit(None).cast("long").alias("rollup_count"),
                  F.col("count").alias("raw_count"))))
    # Grouping is a full outer join in which null keys meet, with partial sums before the shuffle.
    both = tagged.groupBy(*KEYS).agg(F.sum("rollup_count").alias("rollup_count"),
                                     F.sum("raw_count").alias("raw_count"))
    status = (F.when(F.col("rollup_count").isNull(), "missing")
              .when(F.col("raw_count").isNull(), "extra")
              .when(F.col("rollup_count") != F.col("raw_count"), "diff").otherwise("match"))
    return both.withColumn("status", status)


def streaming_rollup(logs: DataFrame, delay: str) -> DataFrame:
    """``hourly_rollup`` of a stream; an hour is emitted once the watermark has passed it."""
    counted = (logs.withColumn("at", instant(F.col("created_at"))).withWatermark("at", delay)
               .groupBy(F.window("at", "1 hour").alias("span"), "source", "log_level")
               .agg(F.count("*").alias("count")))
    start = wall_time(F.col("span.start"))
    return counted.select(log_date(start).alias("log_date"), log_hour(start).alias("hour"),
                          "source", "log_level", "count")

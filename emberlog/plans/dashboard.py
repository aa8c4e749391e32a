"""The composite dashboard: all panels, as single frames or as one flat frame."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import is_error
from emberlog.functions.times import at, log_date, log_hour, parse, to_minute
from emberlog.operators.counts import (counted_hours, counted_levels, counted_trends, hourly_stats_rollup,
                                       log_counts_rollup, recent_errors, source_stats_rollup)
from emberlog.operators.metrics import fill_minutes, minute_metrics, rolling_metrics
from emberlog.session import materialize
from emberlog.sources.tables import between_closed, between_dates


def status_panel(logs: DataFrame, as_of: datetime | str, span: int = 5) -> DataFrame:
    """Rates and status over the last whole minutes before ``as_of``."""
    start, end = status_range(as_of, span)
    return status_of_minutes(minute_metrics(between_closed(logs, start, end - timedelta(microseconds=1))), as_of, span)


def status_range(as_of: datetime | str, span: int) -> tuple[datetime, datetime]:
    end = parse(as_of).replace(second=0, microsecond=0)
    return end - timedelta(minutes=span), end


def status_of_minutes(minutes: DataFrame, as_of: datetime | str, span: int) -> DataFrame:
    start, end = status_range(as_of, span)
    timed = minutes.withColumn("avg_response_ms", F.lit(0).cast("long"))
    last = end - timedelta(minutes=1)
    return (rolling_metrics(fill_minutes(timed, start, end), span)
            .filter(F.col("minute") == F.lit(str(last)).cast("timestamp_ntz")))


def panel_counts(logs: DataFrame, first: datetime, last: datetime, as_of: datetime | str, span: int) -> DataFrame:
    """Logs by day, hour, source and level, by whether they lie in the closed range, and by minute where the status
    needs it. One scan for all counting panels; the result has a row per bucket and is written, so none scans again."""
    created, (start, end) = F.col("created_at"), status_range(as_of, span)
    recent = (created >= at(start)) & (created < at(end))
    return materialize(logs.groupBy(
        log_date(created).alias("log_date"), log_hour(created).alias("hour"), "source", "log_level",
        F.coalesce(created.between(at(first), at(last)), F.lit(False)).alias("inside"),
        F.when(recent, to_minute(created)).alias("minute")).agg(F.count("*").alias("count")))


def dashboard_stats(logs: DataFrame, start: datetime | str | None = None,
                    end: datetime | str | None = None, source: str | None = None,
                    as_of: datetime | str | None = None, day: date | str | None = None,
                    stats: DataFrame | None = None, span: int = 5) -> dict[str, DataFrame]:
    """One frame per panel. Counts, hours and sources come from the rollup where it is given.

    The range defaults to the day before ``as_of``, the hourly panel to the day of its end, the
    trend to the seven days before its start up to its end. Logs are scanned once to count, over the
    days that the panels show, and once for the newest errors.
    """
    last = parse(end if end is not None else as_of)
    first = parse(start) if start is not None else last - timedelta(hours=24)
    hours = date.fromisoformat(str(day)) if day else last.date()
    since, now = first - timedelta(days=7), as_of or last
    shown = [since.date(), last.date(), hours, *(t.date() for t in status_range(now, span))]
    counts = panel_counts(between_dates(logs, min(shown), max(shown)), first, last, now, span)
    if stats is not None:
        panels = {"log_counts": log_counts_rollup(stats, first, last, source),
                  "hourly_stats": hourly_stats_rollup(stats, hours), "source_stats": source_stats_rollup(stats, first, last)}
    else:
        inside = counts.filter("inside")
        panels = {"log_counts": counted_levels(inside.filter(F.col("source").contains(source)) if source else inside),
                  "hourly_stats": counted_hours(counts, hours),
                  "source_stats": inside.groupBy("source").agg(F.sum("count").alias("count"))
                  .orderBy(F.desc("count"), "source")}
    minutes = counts.filter("minute IS NOT NULL").groupBy("minute").agg(
        F.sum("count").alias("processed"),
        F.coalesce(F.sum(F.when(is_error(F.col("log_level")), F.col("count"))), F.lit(0)).alias("errors"))
    return panels | {"system_status": status_of_minutes(minutes, now, span), "recent_errors": recent_errors(logs),
                     "error_trends": counted_trends(counts, since.date(), last.date())}


def dashboard_flat(panels: dict[str, DataFrame]) -> DataFrame:
    """All panels as rows (panel, key, metric, value), numbers only: recent errors by their ids, newest first."""
    # What names a row of each panel.
    keys = {"log_counts": None, "hourly_stats": "hour", "source_stats": "source", "error_trends": "log_date",
            "system_status": None, "recent_errors": "place"}
    newest = Window.orderBy(F.desc("created_at"), F.desc("id"))  # over the few rows of the panel
    panels = panels | {
        "system_status": panels["system_status"].drop("minute", "status"),
        "recent_errors": panels["recent_errors"].select(F.row_number().over(newest).alias("place"), "id")}
    parts = []
    for name, key in keys.items():
        frame = panels[name]
        metrics = [c for c in frame.columns if c != key]
        pairs = [item for c in metrics for item in (F.lit(c), F.col(c).cast("double"))]
        parts.append(frame.select(
            F.lit(name).alias("panel"),
            (F.col(key).cast("string") if key else F.lit("all")).alias("key"),
            F.stack(F.lit(len(metrics)), *pairs).alias("metric", "value")))
    flat = parts[0]
    for part in parts[1:]:
        flat = flat.unionByName(part)
    return flat

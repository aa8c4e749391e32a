"""The daily jobs over stored tables and their index: archive, rebuild statistics, compact, expire."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.times import parse
from emberlog.operators.archive import archive_logs
from emberlog.schemas import ALERT_SCHEMA, ARCHIVE_DAYS, LOGS_SCHEMA, RETENTION_DAYS, STATISTICS_SCHEMA
from emberlog.sinks.index import COMMITS, expire_index, index_days, rewrite_day
from emberlog.sinks.prints import drifted_days
from emberlog.sinks.tables import (compact_day, counted_write, day_loads, expire_table, read_archive, read_load_logs,
                                   read_logs, rebuild_statistics_day, table_days, table_exists, write_archive)
from emberlog.sources.tables import scan_old_logs


def run_archive(spark: SparkSession, root: str, as_of: datetime | str,
                days: int = ARCHIVE_DAYS) -> int:
    """Archive what is old and not archived yet; returns the number of rows added.

    Days whose ids are all archived are left out before any body is read, so a run costs what is new
    and not what is old.
    """
    archive = f"{root}/archives"
    logs = read_logs(spark, f"{root}/logs")
    known = read_archive(spark, archive) if table_exists(spark, archive) else None
    if known is not None:
        # Only days that the logs still have: the archive of years is not read.
        known = known.filter(F.col("log_date").isin(table_days(spark, f"{root}/logs")))
        open_days = unarchived_days(scan_old_logs(logs, as_of, days), known)
        if not open_days:
            return 0
        pending = F.col("log_date").isin(open_days)
        logs, known = logs.filter(pending), known.filter(pending)
    # The load id is fresh on every run: what an earlier run stored must stay.
    return counted_write(archive_logs(logs, as_of, days, known), write_archive, archive)


def unarchived_days(old: DataFrame, archived: DataFrame) -> list[date]:
    """Days of ``old`` logs whose ids differ from the archived ones: at most one row a day."""
    def ids_of(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("log_date").agg(
            F.count("*").alias(f"{side}_rows"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias(f"{side}_ids"))

    same = (F.col("old_rows") == F.col("archived_rows")) & (F.col("old_ids") == F.col("archived_ids"))
    both = ids_of(old, "old").join(ids_of(archived, "archived"), "log_date", "left")
    return [row.log_date for row in both.filter(~F.coalesce(same, F.lit(False))).select("log_date").collect()]


def run_nightly(spark: SparkSession, root: str, as_of: datetime | str,
                archive_days: int = ARCHIVE_DAYS, retention_days: int = RETENTION_DAYS) -> dict[str, int]:
    """All daily jobs in their order, for the day before ``as_of``. Its rollup is rebuilt from the logs only where the
    prints of its loads tell that it drifted."""
    archived = run_archive(spark, root, as_of, archive_days)
    yesterday = (parse(as_of) - timedelta(days=1)).date()
    # Loads are listed before the logs are read: one that comes later is counted when it comes.
    loads = day_loads(spark, f"{root}/logs", yesterday)
    if drifted_days(spark, root, [yesterday]):
        logs = read_load_logs(spark, f"{root}/logs").filter(F.col("load_id").isin(loads)).drop("load_id")
        rebuild_statistics_day(logs, f"{root}/statistics", yesterday, loads)
    elif len(day_loads(spark, f"{root}/statistics", yesterday)) > 1:
        compact_day(spark, f"{root}/statistics", yesterday, STATISTICS_SCHEMA)
    for table, schema in (("logs", LOGS_SCHEMA), ("alerts", ALERT_SCHEMA)):
        if table_exists(spark, f"{root}/{table}") and len(day_loads(spark, f"{root}/{table}", yesterday)) > 1:
            compact_day(spark, f"{root}/{table}", yesterday, schema)
    index = f"{root}/index"
    if table_exists(spark, f"{index}/{COMMITS}"):
        if index_days(spark, index).get(yesterday, 0) > 1:
            rewrite_day(spark, index, yesterday)
        # The index first: what it lacks and the logs still have is not searched for a moment, never the reverse.
        expire_index(spark, index, as_of, retention_days, read_logs(spark, f"{root}/logs"))
    removed = expire_table(spark, f"{root}/logs", as_of, retention_days)
    return {"archived": archived, "expired": removed}

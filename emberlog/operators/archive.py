"""Archiving and expiry."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.compression import compress, decompress, should_compress
from emberlog.functions.measures import compression_ratio, original_size
from emberlog.functions.times import at, log_date, parse
from emberlog.schemas import (ARCHIVE_DAYS, ARCHIVE_SCHEMA, MIN_COMPRESS_CHARS, RETENTION_DAYS)
from emberlog.sources.tables import scan_old_logs


def with_storage_columns(logs: DataFrame) -> DataFrame:
    """Defaults of the storage columns: not compressed, sizes 0."""
    present = set(logs.columns)

    def column(name: str, kind: str, default):
        known = F.col(name) if name in present else F.lit(None)
        return F.coalesce(known.cast(kind), F.lit(default)).alias(name)

    base = [F.col(name) for name in logs.columns
            if name not in ("compressed", "original_size", "compressed_size")]
    return logs.select(*base, column("compressed", "boolean", False),
                       column("original_size", "int", 0), column("compressed_size", "int", 0))


def archive_compress(logs: DataFrame, min_chars: int = MIN_COMPRESS_CHARS) -> DataFrame:
    """Compress bodies for the archive, keeping the result only where it is smaller.

    Rows that are compressed already pass through unchanged.
    """
    done = F.coalesce(F.col("compressed"), F.lit(False))
    size = original_size(F.col("content"))
    eligible = ~done & should_compress(F.col("content"), min_chars)
    packed = (logs.withColumn("_packed", F.when(eligible, compress(F.col("content"), eligible)))
              .withColumn("_packed_size", F.octet_length("_packed")))
    better = F.coalesce(F.col("_packed_size") < size, F.lit(False))
    sized = F.col("content").isNotNull()
    return packed.withColumns({
        "content": F.when(better, F.col("_packed")).otherwise(F.col("content")),
        "compressed": done | better,
        "original_size": F.when(done | ~sized, F.col("original_size")).otherwise(size),
        "compressed_size": F.when(done | ~sized, F.col("compressed_size"))
        .when(better, F.col("_packed_size")).otherwise(size),
    }).drop("_packed", "_packed_size")


def archive_logs(logs: DataFrame, as_of: datetime | str, days: int = ARCHIVE_DAYS,
                 archived: DataFrame | None = None,
                 min_chars: int = MIN_COMPRESS_CHARS) -> DataFrame:
    """Rows to append to the archive: old, not archived before, compressed where it pays."""
    old = with_storage_columns(scan_old_logs(logs, as_of, days))
    if archived is not None:
        old = old.join(archived.select("id"), "id", "left_anti")
    stamped = archive_compress(old, min_chars).withColumn("archived_at", at(as_of))
    return stamped.select(*ARCHIVE_SCHEMA.names, log_date(F.col("created_at")).alias("log_date"))


def expire_logs(logs: DataFrame, as_of: datetime | str, days: int = RETENTION_DAYS) -> DataFrame:
    """The rows that stay when everything older than ``days`` is deleted."""
    return logs.filter(F.col("created_at") >= at(parse(as_of) - timedelta(days=days)))


def log_history(logs: DataFrame, archives: DataFrame) -> DataFrame:
    """Live and archived logs as one view; a row present in both comes from the archive."""
    columns = ["id", "source", "content", "log_level", "created_at"]
    live = logs.join(archives.select("id"), "id", "left_anti").select(*columns)
    packed = archives.select(
        "id", "source", decompress(F.col("content"), F.col("compressed")).alias("content"),
        "log_level", "created_at")
    return live.unionByName(packed)


def compression_report(rows: DataFrame, *by: str, subtotals: bool = False) -> DataFrame:
    """Rows, compressed rows, bytes before and after, and the saved share; overall or ``by`` columns."""
    grouped = rows.rollup(*by) if subtotals else rows.groupBy(*by)
    report = grouped.agg(
        F.count("*").alias("total_logs"),
        F.count_if(F.col("compressed")).alias("compressed_logs"),
        F.sum("original_size").alias("original_bytes"),
        F.sum("compressed_size").alias("stored_bytes"))
    return report.withColumn(
        "compression_rate", compression_ratio(F.col("original_bytes"), F.col("stored_bytes")))

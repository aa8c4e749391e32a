"""Log files: whole-file reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.levels import derive_level


def lines_to_events(lines: DataFrame) -> DataFrame:
    """Raw lines (``source``, ``content``) as events: level from the line, and the time of collection
    where the lines carry it as ``received``. A line's ``position`` goes along."""
    time = F.col("received") if "received" in lines.columns else F.lit(None).cast("timestamp_ntz")
    return lines.select(
        "source", "content", derive_level(F.col("content")).alias("logLevel"), time.alias("timestamp"),
        *[name for name in ("position",) if name in lines.columns])


def read_log_files(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """Every line of every matching file; ``source`` is the file name."""
    raw = spark.read.option("pathGlobFilter", glob).text(folder)
    return raw.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"))

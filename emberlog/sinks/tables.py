"""Partitioned Parquet tables for logs, statistics, archives and alerts.

Every table is cut by ``log_date`` and, below it, by ``load_id``. A load replaces only the partitions
it writes itself, so repeating a load with the same id leaves the table as it was.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.times import at, log_date, on, parse
from emberlog.operators.archive import with_storage_columns
from emberlog.schemas import (ALERT_SCHEMA, ARCHIVE_SCHEMA, LOGS_SCHEMA, RETENTION_DAYS,
                              STATISTICS_KEYS, STATISTICS_SCHEMA)

#: Loads that replace others of a day are named by this and count once their row is in the manifest.
BASE_LOAD = "base-"
PARTITIONS = ("log_date", "load_id")
MANIFEST = "_loads"
MANIFEST_SCHEMA = "log_date date, load_id string, absorbed boolean"


def _partitioned(schema: T.StructType) -> T.StructType:
    fields = [f for f in schema.fields if f.name not in PARTITIONS]
    return T.StructType(fields + [T.StructField("log_date", T.DateType()),
                                  T.StructField("load_id", T.StringType())])


def _write(rows: DataFrame, path: str, load_id: str | None, *sort: str) -> str:
    """Write one load. Rebalancing gives a day one writer, and more where the day is large."""
    load = load_id or uuid.uuid4().hex
    known = _manifest(rows.sparkSession, path)
    if known is not None:  # a load whose day was rewritten since is in there already
        done = known.filter((F.col("load_id") == load) & F.col("absorbed")).select("log_date")
        rows = rows.join(F.broadcast(done), "log_date", "left_anti")
    spread = rows.withColumn("load_id", F.lit(load)).hint("rebalance", F.col("log_date"))
    (spread.sortWithinPartitions("log_date", *sort)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))
    return load


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """What rewrites of days have put in (absorbed: false) and taken out (true), if there were any."""
    folder = f"{path}/{MANIFEST}"
    return spark.read.schema(MANIFEST_SCHEMA).parquet(folder) if table_exists(spark, folder) else None


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that count: of loads that no rewrite has taken out, and of finished rewrites."""
    rows = spark.read.schema(_partitioned(schema)).parquet(path)
    known = _manifest(spark, path)
    base = F.col("load_id").startswith(BASE_LOAD)
    if known is None:
        return rows.filter(~base)
    states = known.groupBy("log_date", "load_id").agg(F.max("absorbed").alias("_absorbed"))
    counts = F.coalesce(~F.col("_absorbed"), ~base)
    return rows.join(F.broadcast(states), list(PARTITIONS), "left").filter(counts).select(*rows.columns)


def write_logs(rows: DataFrame, path: str, load_id: str | None = None) -> str:
    """Store logs; returns the load id. Files are sorted so that their statistics prune searches."""
    stored = with_storage_columns(rows).withColumn("log_date", log_date(F.col("created_at")))
    return _write(stored.select(*LOGS_SCHEMA.names, "log_date"), path, load_id,
                  "source", "log_level", "created_at")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, LOGS_SCHEMA).drop("load_id")


def read_load_logs(spark: SparkSession, path: str) -> DataFrame:
    """Stored logs with the load that brought them."""
    return _read(spark, path, LOGS_SCHEMA)


def counted_write(rows: DataFrame, writer, *args) -> int:
    """Run ``writer(rows, *args)`` and return how many rows went through, without a second pass."""
    seen = Observation()
    writer(rows.observe(seen, F.count("*").alias("rows")), *args)
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        if rows.isEmpty():  # Spark drops the counter together with a plan it finds to be empty
            return 0
        raise


def write_archive(rows: DataFrame, path: str, load_id: str | None = None) -> str:
    return _write(rows.select(*ARCHIVE_SCHEMA.names, "log_date"), path, load_id,
                  "source", "log_level", "created_at")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ARCHIVE_SCHEMA).drop("load_id")


def write_statistics(delta: DataFrame, path: str, load_id: str | None = None) -> str:
    """Add a load's counts to the rollup. Loads stay apart in the table and are summed when read,
    so an upsert is one append of its own counts and a repeated load counts once."""
    return _write(delta.select(*STATISTICS_SCHEMA.names), path, load_id, "hour", "source")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    loads = _read(spark, path, STATISTICS_SCHEMA)
    return loads.groupBy(*STATISTICS_KEYS).agg(F.sum("count").alias("count"))


def write_alerts(alerts: DataFrame, path: str, load_id: str | None = None,
                 enabled: bool = True) -> str | None:
    """Append alerts to the alert table, unless alerting is switched off."""
    if not enabled:
        return None
    dated = alerts.withColumn("log_date", log_date(F.col("alert_ts")))
    return _write(dated, path, load_id, "alert_ts")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ALERT_SCHEMA).drop("load_id")


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def table_exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _folder(spark, path)
    return filesystem.exists(target)


def table_days(spark: SparkSession, path: str) -> list[date]:
    """Days the table has a partition for; read from folder names only."""
    filesystem, target = _folder(spark, path)
    names = [entry.getPath().getName() for entry in filesystem.listStatus(target)]
    return sorted(date.fromisoformat(name.split("=", 1)[1])
                  for name in names if name.startswith("log_date="))


def day_loads(spark: SparkSession, path: str, day: date | str) -> list[str]:
    """Loads that a day's folder holds now; read from folder names only."""
    filesystem, folder = _folder(spark, f"{path}/log_date={day}")
    if not filesystem.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in filesystem.listStatus(folder)]
    return sorted(name.split("=", 1)[1] for name in names if name.startswith("load_id="))


def replace_day(rows: DataFrame, path: str, day: date | str, loads: list[str]) -> None:
    """Put ``rows`` in place of ``loads`` of one day; other loads stay, whenever they come.

    The rows are written aside and moved in, and one manifest file makes them count and the old loads not:
    before it readers see the old state, after it the new one, and a crash leaves either. Writers of an
    old load's replay find it in the manifest. The old folders go last.
    """
    spark = rows.sparkSession
    staging, base = f"{path}/_staging-{uuid.uuid4().hex}", f"{BASE_LOAD}{uuid.uuid4().hex}"
    _write(rows.filter(F.col("log_date") == on(day)), staging, base)
    filesystem, home = _folder(spark, f"{path}/log_date={day}")
    _, new = _folder(spark, f"{staging}/log_date={day}/load_id={base}")
    if filesystem.exists(new):
        filesystem.mkdirs(home)
        filesystem.rename(new, _folder(spark, f"{path}/log_date={day}/load_id={base}")[1])
    states = [(load, True) for load in loads] + [(base, False)]
    (spark.createDataFrame(states, "load_id string, absorbed boolean")
     .select(on(day).alias("log_date"), "load_id", "absorbed").coalesce(1)
     .write.mode("append").parquet(f"{path}/{MANIFEST}"))
    for load in loads:
        filesystem.delete(_folder(spark, f"{path}/log_date={day}/load_id={load}")[1], True)
    filesystem.delete(_folder(spark, staging)[1], True)
    spark.catalog.refreshByPath(path)


def compact_day(spark: SparkSession, path: str, day: date | str, schema: T.StructType) -> None:
    """Merge the small loads of one day into one. Replaying a merged load changes nothing."""
    loads = day_loads(spark, path, day)
    stored = _read(spark, path, schema).filter(
        (F.col("log_date") == on(day)) & F.col("load_id").isin(loads)).drop("load_id")
    replace_day(stored, path, day, loads)


def rebuild_statistics_day(logs: DataFrame, path: str, day: date | str, log_loads: list[str] | None = None) -> None:
    """Replace one day of the rollup by counts of its raw logs. ``log_loads`` names the loads of these logs:
    what such a load adds to the rollup later is counted already."""
    from emberlog.operators.rollup import rebuild_daily_statistics
    spark = logs.sparkSession
    loads = sorted({*day_loads(spark, path, day), *(log_loads or [])})
    replace_day(rebuild_daily_statistics(logs, day), path, day, loads)


def expire_table(spark: SparkSession, path: str, as_of: datetime | str,
                 days: int = RETENTION_DAYS, schema: T.StructType = LOGS_SCHEMA) -> int:
    """Delete logs older than ``days`` before ``as_of`` and return how many.

    Whole days go as folders and leave a tombstone for each of their loads, so that no replay brings them back; only
    the day the cutoff falls in is rewritten.
    """
    cutoff = parse(as_of) - timedelta(days=days)
    old_days = [day for day in table_days(spark, path) if day <= cutoff.date()]
    if not old_days:
        return 0
    stored = _read(spark, path, schema)
    old = (F.col("log_date") <= on(cutoff.date())) & (F.col("created_at") < at(cutoff))
    removed = stored.filter(old).count()
    if cutoff.date() in old_days:
        loads = day_loads(spark, path, cutoff.date())
        kept = stored.filter((F.col("log_date") == on(cutoff.date())) & F.col("load_id").isin(loads)
                             & (F.col("created_at") >= at(cutoff)))
        replace_day(kept.drop("load_id"), path, cutoff.date(), loads)
    whole = [day for day in old_days if day < cutoff.date()]
    gone = [(day, load, True) for day in whole for load in day_loads(spark, path, day)]
    if gone:  # tombstones first: a replay of these loads brings nothing back
        spark.createDataFrame(gone, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    for day in whole:
        filesystem, folder = _folder(spark, f"{path}/log_date={day}")
        filesystem.delete(folder, True)
    spark.catalog.refreshByPath(path)
    return removed

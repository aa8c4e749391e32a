"""Fingerprints of stored logs by day and load: the rollup is checked against them, not against the logs.

A print is a number of rows and the sum of a hash of (hour, source, level) over them. Both add up over loads, and the
rollup's counts give the same two numbers, so a day whose sums agree has the same counts by key. A load is read once in
its life, without its bodies; the names and sizes of its files tell whether it was written anew since.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.times import log_hour
from emberlog.operators.rollup import reconcile_statistics
from emberlog.schemas import LOGS_SCHEMA
from emberlog.sinks.tables import (BASE_LOAD, _folder, _manifest, _partitioned, day_loads, read_logs, read_statistics,
                                   table_exists)

PRINTS = "_prints"
PRINT_SCHEMA = "log_date date, load_id string, files string, rows long, keys decimal(38,0)"
LIVE_SCHEMA = "log_date date, load_id string, files string"


def _key_hash(hour: Column) -> Column:
    """Null sources and levels are keys of their own."""
    keys = [part for name in ("source", "log_level") for part in (F.col(name).isNull(), F.col(name))]
    return F.xxhash64(hour.cast("int"), *keys)


def live_loads(spark: SparkSession, path: str, days: list[date]) -> list[tuple[date, str, str]]:
    """(day, load, digest of its file names and sizes) of the loads that count on these days, from listings alone."""
    known, states = _manifest(spark, path), {}
    if known is not None and days:
        rows = known.filter(F.col("log_date").isin(days)).groupBy("log_date", "load_id").agg(F.max("absorbed"))
        states = {(day, load): absorbed for day, load, absorbed in rows.collect()}
    found = []
    for day in days:
        for load in day_loads(spark, path, day):
            if states.get((day, load), load.startswith(BASE_LOAD)):
                continue
            filesystem, folder = _folder(spark, f"{path}/log_date={day}/load_id={load}")
            files = sorted(f"{entry.getPath().getName()}:{entry.getLen()}" for entry in filesystem.listStatus(folder))
            found.append((day, load, hashlib.sha1("\n".join(files).encode()).hexdigest()))
    return found


def read_prints(spark: SparkSession, path: str, live: list[tuple[date, str, str]]) -> DataFrame:
    """Prints of these loads in their present form. A load that was printed twice counts once."""
    wanted = spark.createDataFrame(live, LIVE_SCHEMA)
    folder = f"{path}/{PRINTS}"
    if not table_exists(spark, folder):
        return wanted.filter("false").select("*", F.lit(0).cast("long").alias("rows"),
                                             F.lit(0).cast("decimal(38,0)").alias("keys"))
    stored = spark.read.schema(PRINT_SCHEMA).parquet(folder).filter(F.col("log_date").isin([d for d, _, _ in live]))
    return stored.dropDuplicates(["log_date", "load_id", "files"]).join(
        wanted, ["log_date", "load_id", "files"], "left_semi")


def fill_prints(spark: SparkSession, path: str, days: list[date]) -> int:
    """Print the loads of these days that have no print yet; returns how many there were."""
    live = live_loads(spark, path, days)
    if not live:
        return 0
    new = spark.createDataFrame(live, LIVE_SCHEMA).join(
        read_prints(spark, path, live), ["log_date", "load_id", "files"], "left_anti").collect()
    if not new:
        return 0
    logs = spark.read.schema(_partitioned(LOGS_SCHEMA)).parquet(path).filter(
        F.col("log_date").isin([row.log_date for row in new]) & F.col("load_id").isin([row.load_id for row in new]))
    hashed = _key_hash(log_hour(F.col("created_at"))).cast("decimal(28,0)")
    prints = logs.groupBy("log_date", "load_id").agg(F.count("*").alias("rows"), F.sum(hashed).alias("keys"))
    (spark.createDataFrame(new, LIVE_SCHEMA).join(prints, ["log_date", "load_id"], "left")
     .select("log_date", "load_id", "files", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
             F.coalesce("keys", F.lit(0)).cast("decimal(38,0)").alias("keys"))
     .coalesce(1).write.mode("append").parquet(f"{path}/{PRINTS}"))
    return len(new)


def drifted_days(spark: SparkSession, root: str, days: list[date]) -> list[date]:
    """Those of these days on which the rollup differs from the logs: at most one row a day reaches the driver."""
    path, sides = f"{root}/logs", []
    fill_prints(spark, path, days)
    live = live_loads(spark, path, days)
    if live:
        sides.append(read_prints(spark, path, live).select("log_date", "rows", "keys"))
    if table_exists(spark, f"{root}/statistics"):
        counted = read_statistics(spark, f"{root}/statistics").filter(F.col("log_date").isin(days))
        keys = _key_hash(F.col("hour")).cast("decimal(20,0)") * F.col("count").cast("decimal(17,0)")
        sides.append(counted.select("log_date", (-F.col("count")).alias("rows"), (-keys).alias("keys")))
    if not sides:
        return []
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    sums = both.groupBy("log_date").agg(F.sum("rows").alias("rows"),
                                        F.sum(F.col("keys").cast("decimal(38,0)")).alias("keys"))
    same = F.coalesce((F.col("rows") == 0) & (F.col("keys") == 0), F.lit(False))
    return sorted(row.log_date for row in sums.filter(~same).select("log_date").collect())


def reconcile_stored(spark: SparkSession, root: str, days: list[date]) -> DataFrame:
    """Keys of these days on which the stored rollup differs from the stored logs; only drifted days are read."""
    drifted = F.col("log_date").isin(drifted_days(spark, root, days))
    found = reconcile_statistics(read_statistics(spark, f"{root}/statistics").filter(drifted),
                                 read_logs(spark, f"{root}/logs").filter(drifted))
    return found.filter(F.col("status") != "match")

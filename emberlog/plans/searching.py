"""Search over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from emberlog.functions.compression import decompress
from emberlog.operators.counts import recent_errors
from emberlog.operators.search import build_index, search
from emberlog.schemas import RECENT_ERRORS
from emberlog.sinks.index import indexed_loads, read_index
from emberlog.sinks.tables import BASE_LOAD, read_load_logs, read_logs, table_days, table_exists


def readable(logs: DataFrame) -> DataFrame:
    """Stored logs with their original bodies."""
    return logs.withColumn("content", decompress(F.col("content"), F.col("compressed")))


def recent_store_errors(spark: SparkSession, root: str, limit: int = RECENT_ERRORS) -> DataFrame:
    """The newest stored errors. Days are read from the newest on, twice as many each time, until there are enough."""
    path, many = f"{root}/logs", 1
    days = table_days(spark, path)[::-1]
    logs = read_logs(spark, path)
    while True:
        found = logs.filter(F.col("log_date").isin(days[:many]) & (F.col("log_level") == "ERROR"))
        if many >= len(days) or len(found.select("id").take(limit)) >= limit:
            return recent_errors(found, limit)
        many *= 2


def search_store(spark: SparkSession, root: str, engine: str = "auto", **criteria) -> DataFrame:
    """Search the tables below ``root``: through the index where one is stored, else through the logs.

    "auto" searches loads that are wholly indexed through the index and the logs of all others by the same rules, so
    that the result is that of a full index. A load whose index files are fewer or shorter than when they were written
    counts as not indexed; that is checked before they are read. Where no load is indexed, or the index can't be
    opened, it searches the logs.
    "index" searches what is in the index only. Sort and cut the result with ``page``; count it with ``page_totals``.
    """
    path, logs = f"{root}/index", read_load_logs(spark, f"{root}/logs")
    index, rest = None, None
    if engine == "index" and table_exists(spark, f"{path}/terms"):
        index = read_index(spark, path)
    elif engine == "auto":
        try:
            loads = indexed_loads(spark, path)
            if loads is not None:
                index = read_index(spark, path, loads)
                rest = _not_indexed(logs, loads, index.documents)
        except AnalysisException:
            index = None
    found = search(readable(logs.drop("load_id")), index, engine, **criteria)
    if index is None or rest is None:
        return found
    return found.unionByName(search(logs, build_index(readable(rest.drop("load_id"))), **criteria))


def _not_indexed(logs: DataFrame, loads: DataFrame, documents: DataFrame) -> DataFrame:
    """Logs of loads that are not indexed. Rewritten days mix rows of several loads, so there the ids tell. Loads are
    fewer than the folders that the driver lists; a shuffle would bring all logs of one load to one task."""
    logs = logs.join(F.broadcast(loads), "load_id", "left_anti")
    base = F.col("load_id").startswith(BASE_LOAD)
    known = documents.select(F.col("id").alias("_id"))
    mixed = logs.filter(base).join(known, F.col("id").cast("string") == F.col("_id"), "left_anti")
    return logs.filter(~base).unionByName(mixed)

"""The log table in a relational database, through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.archive import with_storage_columns
from emberlog.schemas import LOGS_SCHEMA

# Fixed value: rows per insert batch.
BATCH_ROWS = 500


def write_logs_jdbc(rows: DataFrame, url: str, table: str = "logs", connections: int = 16, **options: str) -> None:
    """Append logs with batched inserts over a bounded number of connections."""
    stored = with_storage_columns(rows).select(*LOGS_SCHEMA.names)
    (stored.coalesce(connections).write.format("jdbc").option("url", url).option("dbtable", table)
     .option("batchsize", BATCH_ROWS).options(**options).mode("append").save())


def read_logs_jdbc(spark: SparkSession, url: str, lower_id: int, upper_id: int, table: str = "logs",
                   partitions: int = 16, **options: str) -> DataFrame:
    """Logs read in parallel by ranges of their id; no row is left out, whatever the bounds."""
    rows = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", "id").option("lowerBound", lower_id).option("upperBound", upper_id)
            .option("numPartitions", partitions).option("preferTimestampNTZ", "true")
            .options(**options).load())
    return rows.withColumn("log_date", F.col("created_at").cast("date"))

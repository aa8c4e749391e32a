"""Events out: keyed messages and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.times import iso_text, plain_text
from emberlog.schemas import EVENT_SCHEMA

# The export's columns.
EXPORT_COLUMNS = {"id": "ID", "created_at": "Timestamp", "source": "Source", "log_level": "Level",
                  "content": "Content"}


def publish_events(events: DataFrame) -> DataFrame:
    """Events as messages: the source is the key, so one source keeps its order; JSON is the value."""
    wire = events.withColumn("timestamp", iso_text(F.col("timestamp")))
    return wire.select(F.col("source").alias("key"),
                       F.to_json(F.struct(*EVENT_SCHEMA.names)).alias("value"))


def write_messages(messages: DataFrame, folder: str | None = None, servers: str | None = None,
                   topic: str = "raw-logs") -> None:
    """Send messages to a topic, or append their values to a folder, one a line."""
    if servers:
        (messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("topic", topic).save())
    else:
        messages.select("value").write.mode("append").text(folder)


def export_rows(logs: DataFrame) -> DataFrame:
    shown = logs.withColumn("created_at", plain_text(F.col("created_at")))
    return shown.select(*[F.col(name).alias(title) for name, title in EXPORT_COLUMNS.items()])


def export_csv(logs: DataFrame, path: str) -> None:
    """All given logs as CSV with a header; every field is quoted, quotes are doubled."""
    (export_rows(logs).write.mode("overwrite")
     .csv(path, header=True, quoteAll=True, escape='"', emptyValue=""))

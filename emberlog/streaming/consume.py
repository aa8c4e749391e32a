"""Streaming ingest: messages to the log table, the rollup and the index, once per message."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.compression import decompress
from emberlog.operators.ingest import to_log_rows, with_event_id
from emberlog.operators.rollup import increment_statistics
from emberlog.sinks.index import index_logs
from emberlog.sinks.tables import write_logs, write_statistics
from emberlog.sources.events import parse_messages, rejects


def load_name(batch: DataFrame, batch_id: int) -> str:
    """Load id of a micro-batch: equal when the batch is retried, unlike that of any other stream. Spark
    keeps a query's id in its checkpoint, so a new checkpoint is a new stream."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or 'stream'}-{batch_id:012d}"


def store_batch(logs: DataFrame, root: str, load_id: str, with_index: bool = False) -> None:
    """One load into all tables below ``root``. Repeating it replaces the same partitions."""
    write_logs(logs, f"{root}/logs", load_id)
    write_statistics(increment_statistics(logs), f"{root}/statistics", load_id)
    if with_index:
        readable = logs.withColumn("content", decompress(F.col("content"), F.col("compressed")))
        index_logs(readable, f"{root}/index", load_id)


def consume_batch(messages: DataFrame, root: str, load_id: str, as_of: datetime | str,
                  with_index: bool = False, with_id: Callable = with_event_id) -> None:
    """Decode, size, compress and store one batch of messages; malformed ones go to ``rejects``."""
    # Parsed and compressed once, then written and counted; lost blocks are computed again.
    parsed = to_log_rows(with_id(parse_messages(messages)), as_of, keep=("rejected",))
    kept = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        store_batch(kept.filter(F.col("rejected").isNull()).drop("rejected"), root, load_id, with_index)
        (rejects(kept).withColumn("load_id", F.lit(load_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("load_id").parquet(f"{root}/rejects"))
    finally:
        kept.unpersist()


def consume_events(messages: DataFrame, root: str, checkpoint: str,
                   as_of: datetime | str | Callable[[int], datetime], with_index: bool = False, **trigger) -> StreamingQuery:
    """Store a stream of messages. A failed micro-batch fails the query and is retried from its
    checkpoint under the same load id, so no message is lost and none counts twice.

    Events without a time get the time their message was received, where the source tells it, else
    ``as_of``: a moment, or a function of the batch number that answers alike on a retry."""

    def store(batch: DataFrame, batch_id: int) -> None:
        now = as_of(batch_id) if callable(as_of) else as_of
        consume_batch(batch, root, load_name(batch, batch_id), now, with_index)

    return (messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run an append stream over all input that is there now, into a Parquet folder."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def emit_alerts(alerts: DataFrame, sink: Callable[[DataFrame, str], object],
                checkpoint: str, **trigger) -> StreamingQuery:
    """Hand every micro-batch of alerts, with its load id, to ``sink``."""

    def send(batch: DataFrame, batch_id: int) -> None:
        sink(batch, load_name(batch, batch_id))

    return (alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())

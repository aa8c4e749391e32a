"""Events from messages: decoding, and the streams that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.schemas import EVENT_SCHEMA

CORRUPT = "_corrupt_record"
#: What a source may tell about a message: where it lies, unlike any other, and when it came.
DELIVERY = ("position", "received")
DECODED = T.StructType(EVENT_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """All messages as events; ``rejected`` holds the text of a malformed one and is null otherwise."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raw = F.col(value).cast("string")
    carried = [F.col(name) for name in DELIVERY if name in messages.columns]
    event = F.from_json(raw, DECODED, options)
    # Filters do not move below a generator: without it each of them would parse the text again.
    parsed = messages.select(raw.alias("raw"), *carried, F.inline(F.array(F.struct(event.alias("event")))))
    bad = F.col("event").isNull() | F.col(f"event.{CORRUPT}").isNotNull()
    times = F.coalesce("event.timestamp", F.col("received")) if "received" in messages.columns else F.col("event.timestamp")
    names = [name for name in EVENT_SCHEMA.names if name != "timestamp"]
    return parsed.select(
        *[F.col(f"event.{name}").alias(name) for name in names], times.alias("timestamp"),
        *[name for name in ("position",) if name in messages.columns],
        F.when(bad, F.coalesce("raw", F.lit(""))).alias("rejected"))


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Well-formed messages as events. Unknown fields are ignored, missing ones are null."""
    return parse_messages(messages, value).filter(F.col("rejected").isNull()).drop("rejected")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rejected").isNotNull()).select(
        F.col("rejected").alias("raw"), F.lit("malformed json").alias("reason"))


def decode_rejects(messages: DataFrame, value: str = "value") -> DataFrame:
    """The messages ``decode_events`` leaves out."""
    return rejects(parse_messages(messages, value))


def read_event_stream(spark: SparkSession, folder: str | None = None,
                      servers: str | None = None, topic: str = "raw-logs",
                      max_per_trigger: int | None = None) -> DataFrame:
    """Messages (``value`` string) from a topic, or from a folder of one-message-per-line files."""
    if servers:
        stream = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                  .option("subscribe", topic).option("startingOffsets", "earliest"))
        if max_per_trigger:
            stream = stream.option("maxOffsetsPerTrigger", max_per_trigger)
        return stream.load().select(
            F.col("value").cast("string").alias("value"),
            F.concat_ws(":", "topic", "partition", "offset").alias("position"),
            F.col("timestamp").cast("timestamp_ntz").alias("received"))
    stream = spark.readStream.format("text")
    if max_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_per_trigger)
    return stream.load(folder)


def requests_to_events(requests: DataFrame) -> DataFrame:
    """Caller rows in any column order, missing columns as null, as events."""
    present = set(requests.columns)
    return requests.select(*[
        (F.col(field.name) if field.name in present else F.lit(None))
        .cast(field.dataType).alias(field.name) for field in EVENT_SCHEMA])

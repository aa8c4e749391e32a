"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import levels, measures, text, times
from emberlog.functions.compression import (compress, decompress, is_compressed, should_compress,
                                            utf16_length)
from emberlog.operators import archive, counts, ingest, metrics, patterns, rollup, search
from emberlog.plans import dashboard, nightly, searching
from emberlog.plans.params import (ARCHIVE_DAYS, AS_OF, BURST, COUNT_END, COUNT_START, DAY,
                                   DENSE_BURST, DOC_KEYWORD, KEYWORD, REPEAT_THRESHOLD,
                                   REPEAT_WINDOW, RETENTION_DAYS, STATUS_AS_OF)
from emberlog.schemas import LOGS_SCHEMA
from emberlog.session import scratch_path, ship_package
from emberlog.sinks import index as index_sinks
from emberlog.sinks import messages, prints, tables as sinks
from emberlog.sources import events as event_sources
from emberlog.sources import files, tail
from emberlog.sources import tables as sources
from emberlog.streaming import consume, detectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return build


# --- inputs derived from the given tables -------------------------------------------------------

def logs_of(spark: SparkSession, folder: str) -> DataFrame:
    return sources.logs_from_events(sources.table(spark, folder, "events"))


def doc_logs_of(spark: SparkSession, folder: str) -> DataFrame:
    return sources.logs_from_documents(sources.table(spark, folder, "documents"))


def stats_of(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.hourly_rollup(logs_of(spark, folder))


def wire_events(logs: DataFrame) -> DataFrame:
    return logs.select("id", "source", "content", F.col("log_level").alias("logLevel"),
                       F.col("created_at").alias("timestamp"))


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a missing time, a blank or missing level, a blank or missing source."""
    events = sources.table(spark, folder, "events")
    slot, kind = F.col("user_id") % 10, F.col("event_type")
    source = F.concat(F.lit("svc-"), slot.cast("string"))
    return events.select(
        F.col("event_id").alias("id"),
        F.when(slot == 3, F.when(F.col("event_id") % 2 == 0, "  ").otherwise(" \t\n")).when(slot != 7, source).alias("source"),
        F.concat(kind, F.lit(" event while handling request: "), F.col("props")).alias("content"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "")
        .when(kind == "view", "INFO").alias("logLevel"),
        F.when(kind != "purchase", F.col("ts")).alias("timestamp"))


def line_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs as raw application lines."""
    logs = logs_of(spark, folder)
    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSS")
    return logs.select(F.concat(stamp, F.lit(" [main] "), "log_level", F.lit(" "), "source",
                                F.lit(" - "), "content").alias("value"))


def message_folder(spark: SparkSession, folder: str) -> str:
    """Logs as one JSON message a line, some cut off in the middle."""
    path = scratch_path(spark, "messages")
    broken_messages(spark, folder).write.text(path)
    return path


def broken_messages(spark: SparkSession, folder: str) -> DataFrame:
    logs = logs_of(spark, folder)
    sent = messages.publish_events(wire_events(logs))
    broken = F.col("key") == "svc-4"
    return sent.select(F.when(broken, F.substring("value", 1, 25)).otherwise(F.col("value")).alias("value"))


# --- sources ------------------------------------------------------------------------------------

@query
def read_log_files(spark, folder):
    path = scratch_path(spark, "lines")
    line_logs(spark, folder).write.text(path)
    lines = files.lines_to_events(files.read_log_files(spark, path, "*.txt"))
    return lines.select("content", F.col("logLevel").alias("log_level"))


@query
def tail_log_files(spark, folder):
    path, out = scratch_path(spark, "growing"), scratch_path(spark, "tailed")
    line_logs(spark, folder).write.text(path)
    lines = files.lines_to_events(tail.tail_log_files(spark, path, "*.txt", split_bytes=1 << 18))
    consume.drain(lines.select("content", F.col("logLevel").alias("log_level")), out, f"{out}-state")
    return spark.read.parquet(out)


@query
def read_event_stream(spark, folder):
    out = scratch_path(spark, "events")
    stream = event_sources.read_event_stream(spark, message_folder(spark, folder))
    consume.drain(event_sources.decode_events(stream), out, f"{out}-state")
    return spark.read.parquet(out)


@query
def decode_events(spark, folder):
    return event_sources.decode_events(broken_messages(spark, folder))


@query
def decode_rejects(spark, folder):
    return event_sources.decode_rejects(broken_messages(spark, folder))


@query
def scan_old_logs(spark, folder):
    return sources.scan_old_logs(logs_of(spark, folder), AS_OF, ARCHIVE_DAYS)


@query
def scan_day_logs(spark, folder):
    return sources.scan_day_logs(logs_of(spark, folder), DAY)


@query
def find_by_id(spark, folder):
    return sources.find_by_id(logs_of(spark, folder), 42)


@query
def count_all(spark, folder):
    return sources.count_all(logs_of(spark, folder))


@query
def ingest_request(spark, folder):
    requests = wire_events(logs_of(spark, folder)).drop("id", "timestamp")
    return ingest.normalize_events(event_sources.requests_to_events(requests), AS_OF)


# --- sinks --------------------------------------------------------------------------------------

@query
def write_logs(spark, folder):
    path = scratch_path(spark, "logs")
    sinks.write_logs(logs_of(spark, folder), path)
    return sinks.read_logs(spark, path)


@query
def publish_events(spark, folder):
    sent = messages.publish_events(wire_events(logs_of(spark, folder)))
    event = F.from_json("value", event_sources.EVENT_SCHEMA)
    return sent.select("key", event.alias("event")).select(
        "key", "event.source", "event.content", "event.logLevel", "event.timestamp")


@query
def index_documents(spark, folder):
    path = scratch_path(spark, "index")
    index_sinks.index_logs(doc_logs_of(spark, folder), path, with_ngrams=False)
    return index_sinks.read_index(spark, path).documents.drop("log_date", "load_id")


@query
def index_terms(spark, folder):
    path = scratch_path(spark, "index")
    index_sinks.index_logs(doc_logs_of(spark, folder), path, with_ngrams=False)
    return index_sinks.read_index(spark, path).terms.groupBy("term").agg(F.count("*").alias("documents"))


@query
def index_grams(spark, folder):
    """The n-grams of the vocabulary."""
    path = scratch_path(spark, "index")
    index_sinks.index_logs(doc_logs_of(spark, folder), path)
    return index_sinks.read_index(spark, path).grams.groupBy("gram").agg(F.count("*").alias("words"))


@query
def write_archive(spark, folder):
    """Two archive runs over stored logs: the second one finds nothing left to add."""
    root = scratch_path(spark, "archive")
    sinks.write_logs(logs_of(spark, folder), f"{root}/logs")
    nightly.run_archive(spark, root, AS_OF, ARCHIVE_DAYS)
    nightly.run_archive(spark, root, AS_OF, ARCHIVE_DAYS)
    return sinks.read_archive(spark, f"{root}/archives").drop("log_date")


@query
def write_statistics(spark, folder):
    path = scratch_path(spark, "statistics")
    sinks.write_statistics(stats_of(spark, folder), path, "first")
    return sinks.read_statistics(spark, path)


@query
def emit_alerts(spark, folder):
    path = scratch_path(spark, "alerts")
    bursts = patterns.error_burst(logs_of(spark, folder), scope=None, **BURST)
    alerts = patterns.burst_alerts(bursts, BURST["threshold"], BURST["window_seconds"])
    sinks.write_alerts(alerts, path, "first")
    return sinks.read_alerts(spark, path).drop("log_date")


@query
def export_csv(spark, folder):
    path = scratch_path(spark, "export")
    messages.export_csv(logs_of(spark, folder), path)
    shape = ", ".join(f"{name} string" for name in messages.EXPORT_COLUMNS.values())
    return spark.read.schema(shape).csv(path, header=True, quote='"', escape='"')


# --- projections and scalar functions -----------------------------------------------------------

@query
def normalize_events(spark, folder):
    return ingest.normalize_events(gappy_events(spark, folder), AS_OF)


@query
def derive_level(spark, folder):
    lines = line_logs(spark, folder)
    return lines.select("value", levels.derive_level(F.col("value")).alias("log_level"))


@query
def enrich_events(spark, folder):
    return ingest.enrich_events(gappy_events(spark, folder), AS_OF).drop("correlation_id")


@query
def level_rank(spark, folder):
    return logs_of(spark, folder).select("id", levels.level_rank(F.col("log_level")).alias("level_rank"))


@query
def original_size(spark, folder):
    docs = doc_logs_of(spark, folder)
    return docs.select("id", measures.original_size(F.col("content")).alias("original_size"))


@query
def utf16_size(spark, folder):
    return doc_logs_of(spark, folder).select("id", utf16_length(F.col("content")).alias("utf16_units"))


@query
def compress_eligible(spark, folder):
    docs = doc_logs_of(spark, folder)
    return docs.select("id", should_compress(F.col("content")).alias("eligible"))


@query
def detect_compressed(spark, folder):
    """Plain text, Base64 of text, Base64 of gzip-like bytes, and that with a broken end."""
    body = F.encode("content", "UTF-8")

    def base64(data):
        return F.translate(F.base64(data), "\r\n", "")

    gzip_like = base64(F.concat(F.unhex(F.lit("1F8B")), body))
    docs = doc_logs_of(spark, folder).select("id", F.explode(F.array(
        F.struct(F.lit("plain").alias("kind"), F.col("content").alias("body")),
        F.struct(F.lit("base64").alias("kind"), base64(body).alias("body")),
        F.struct(F.lit("gzip").alias("kind"), gzip_like.alias("body")),
        F.struct(F.lit("broken").alias("kind"), F.concat(gzip_like, F.lit("!")).alias("body")))).alias("it"))
    return docs.select("id", "it.kind", is_compressed(F.col("it.body")).alias("compressed"))


@query
def compress_logs(spark, folder):
    """Bodies that are compressed. Stored bytes depend on the zlib build, but every body comes back, and one
    that is stored compressed is smaller than base64 of its plain bytes."""
    body = F.col("content")
    packed = compressed_bodies(spark, folder)
    plain = F.octet_length(F.base64(F.encode(body, "UTF-8")))
    return packed.select(
        "id", "compressed", F.octet_length("content").alias("original_size"),
        (decompress(F.col("packed"), F.col("compressed")) == body).alias("comes_back"),
        F.when(F.col("compressed"), F.octet_length("packed") < plain).otherwise(F.col("packed") == body).alias("fits"))


def compressed_bodies(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("content")
    docs = doc_logs_of(spark, folder).select("id", body, should_compress(body).alias("compressed"))
    return docs.withColumn("packed", compress(body, F.col("compressed")))


@query
def decompress_logs(spark, folder):
    """What comes back after compression: every body, in full."""
    body = F.col("content")
    docs = doc_logs_of(spark, folder).select("id", body, should_compress(body).alias("compressed"))
    packed = docs.withColumn("content", compress(body, F.col("compressed")))
    return packed.select("id", "compressed", decompress(body, F.col("compressed")).alias("content"))


@query
def normalize_message(spark, folder):
    docs = doc_logs_of(spark, folder)
    return docs.select("id", text.normalize_message(F.col("content")).alias("message_pattern"))


@query
def date_hour(spark, folder):
    created = F.col("created_at")
    return logs_of(spark, folder).select("id", times.log_date(created).alias("log_date"),
                                         times.log_hour(created).alias("hour"))


@query
def to_local_time(spark, folder):
    return logs_of(spark, folder).select("id", times.to_local_time(F.col("created_at")).alias("local_time"))


@query
def error_rate(spark, folder):
    errors = F.count_if(levels.is_error(F.col("log_level")))
    return (logs_of(spark, folder).groupBy("source")
            .agg(measures.error_rate(errors, F.count("*")).alias("error_rate")))


@query
def hour_label(spark, folder):
    return (logs_of(spark, folder)
            .groupBy(times.hour_label(times.log_hour(F.col("created_at"))).alias("hour"))
            .agg(F.count("*").alias("total")))


@query
def response_projection(spark, folder):
    return logs_of(spark, folder).select(
        F.col("id").cast("string").alias("id"), "source", "content",
        F.col("log_level").alias("logLevel"), F.col("created_at").alias("timestamp"))


@query
def system_status(spark, folder):
    """Status by source, from its error rate and the mean event value as response time."""
    events = sources.table(spark, folder, "events")
    rows = events.groupBy("user_id").agg(
        measures.error_rate(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("error_rate"),
        F.floor(F.max("value")).cast("long").alias("response_ms"))
    return rows.withColumn("status", levels.system_status(F.col("error_rate"), F.col("response_ms")))


@query
def metric_level(spark, folder):
    return logs_of(spark, folder).select("id", levels.known_level(F.col("log_level")).alias("metric_level"))


@query
def second_precision(spark, folder):
    return logs_of(spark, folder).select("id", times.to_second(F.col("created_at")).alias("timestamp"))


@query
def analyze_tokens(spark, folder):
    words = doc_logs_of(spark, folder).select(F.explode(text.tokens(F.col("content"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("occurrences"))


@query
def analyze_ngrams(spark, folder):
    words = doc_logs_of(spark, folder).select(text.tokens(F.col("content")).alias("words"))
    grams = words.select(F.explode(text.ngrams(F.col("words"))).alias("term"))
    return grams.groupBy("term").agg(F.count("*").alias("documents"))


@query
def render_messages(spark, folder):
    logs = logs_of(spark, folder).filter(levels.is_error(F.col("log_level")))
    return logs.select(
        "id", text.burst_message(10, 60, F.col("source"), F.col("content")).alias("burst"),
        text.repeat_message(F.col("source"), 300, F.lit(3).cast("long"), F.col("content")).alias("repeated"),
        text.pattern_subject(F.lit("Repeated error")).alias("subject"))


@query
def level_share(spark, folder):
    return counts.level_share(counts.log_counts(logs_of(spark, folder), COUNT_START, COUNT_END))


@query
def compression_ratio(spark, folder):
    """The saved share of every body is that of its sizes: 0 where it is stored as it is."""
    before, after = F.octet_length("content"), F.octet_length("packed")
    saved = measures.compression_ratio(before, after)
    exact = F.when(before > 0, (1 - after / before) * 100).otherwise(0.0)
    fine = (F.abs(saved - exact) <= 0.005001) & (F.col("compressed") | (saved == 0)) & (saved < 100)
    return compressed_bodies(spark, folder).select("id", before.alias("original_size"), fine.alias("in_range"))


# --- filters ------------------------------------------------------------------------------------

@query
def filter_events(spark, folder):
    events = wire_events(logs_of(spark, folder))
    marked = events.withColumn("source", F.when(F.col("source") == "svc-9", "performance-test")
                               .otherwise(F.col("source")))
    return ingest.filter_events(marked, "WARN", "svc-1,svc-2")


@query
def route_by_level(spark, folder):
    return ingest.route_by_level(wire_events(logs_of(spark, folder))).select("id", "logLevel", "route")


@query
def errors_only(spark, folder):
    mixed = logs_of(spark, folder).withColumn(
        "log_level", F.when(F.col("source") == "svc-5", F.lower("log_level")).otherwise(F.col("log_level")))
    level = F.col("log_level")
    return mixed.filter(levels.is_error(level)).select(
        "id", "log_level", levels.is_exact_error(level).alias("exact"))


@query
def between_closed(spark, folder):
    return sources.between_closed(logs_of(spark, folder), COUNT_START, COUNT_END)


@query
def source_contains(spark, folder):
    return logs_of(spark, folder).filter(F.col("source").contains("-3")).select("id", "source")


@query
def search_table(spark, folder):
    logs = logs_of(spark, folder)
    return search.search_logs(logs, keyword=KEYWORD.split()[0], level="ERROR", source="SVC-1",
                              content="k", start=COUNT_START, end=COUNT_END)


@query
def search_documents(spark, folder):
    """Table search over stored, compressed bodies: they are made readable first."""
    path = scratch_path(spark, "logs")
    docs = doc_logs_of(spark, folder)
    rows = ingest.to_log_rows(docs.withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"}), AS_OF)
    sinks.write_logs(rows, path)
    stored = sinks.read_logs(spark, path)
    readable = stored.withColumn("content", decompress(F.col("content"), F.col("compressed")))
    return search.search_logs(readable, keyword="license").select("id", "source", "log_level", "created_at")


def _built_index(spark, folder, with_ngrams=False):
    path = scratch_path(spark, "index")
    index_sinks.index_logs(doc_logs_of(spark, folder), path, with_ngrams=with_ngrams)
    return index_sinks.read_index(spark, path)


@query
def search_index_tokens(spark, folder):
    index = _built_index(spark, folder)
    return search.search_index(index, keyword=DOC_KEYWORD, source="src1").drop("log_date")


@query
def search_index_ngrams(spark, folder):
    index = _built_index(spark, folder, with_ngrams=True)
    return search.search_index(index, keyword="zq", level="INFO", mode="ngram_any").drop("log_date")


@query
def index_finders(spark, folder):
    documents = search.index_documents(logs_of(spark, folder))
    found = {
        "level": search.find_by_level(documents, "ERROR"),
        "source": search.find_by_source(documents, "svc-2"),
        "content": search.find_by_content(documents, "CLICK event"),
        "time": search.find_by_time(documents, COUNT_START, COUNT_END)}
    parts = [rows.select(F.lit(name).alias("finder"), "id") for name, rows in found.items()]
    return ingest.append_sources(*parts)


@query
def search_with_fallback(spark, folder):
    """The same search through the index and through the table."""
    index = _built_index(spark, folder)
    criteria = {"level": "ERROR", "source": "src", "start": "2024-01-01 01:00:00", "end": "2024-01-01 09:00:00"}
    logs = doc_logs_of(spark, folder)
    by_index = search.search(logs, index, **criteria).withColumn("engine", F.lit("index"))
    by_table = search.search(logs, **criteria).withColumn("engine", F.lit("table"))
    return by_index.unionByName(by_table).select("engine", "id", "timestamp")


@query
def time_range_preset(spark, folder):
    logs = logs_of(spark, folder)
    parts = []
    for preset in times.RANGE_PRESETS:
        start, end = times.preset_bounds(AS_OF, preset)
        parts.append(counts.log_counts(logs, start, end).select(
            F.lit(preset).alias("preset"), "total", "error"))
    return ingest.append_sources(*parts)


# --- aggregations -------------------------------------------------------------------------------

@query
def log_counts(spark, folder):
    return counts.log_counts(logs_of(spark, folder), COUNT_START, COUNT_END)


@query
def log_counts_source(spark, folder):
    return counts.log_counts(logs_of(spark, folder), COUNT_START, COUNT_END, "svc-3")


@query
def log_counts_rollup(spark, folder):
    return counts.log_counts_rollup(stats_of(spark, folder), COUNT_START, COUNT_END, "svc")


@query
def hourly_stats(spark, folder):
    return counts.hourly_stats(logs_of(spark, folder), DAY)


@query
def hourly_stats_closed(spark, folder):
    """Closed buckets over whole-hour times: every log counts in two hours, save at midnight."""
    logs = logs_of(spark, folder).withColumn("created_at", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
    return counts.hourly_stats(logs, DAY, closed=True)


@query
def hourly_stats_rollup(spark, folder):
    return counts.hourly_stats_rollup(stats_of(spark, folder), DAY)


@query
def source_stats(spark, folder):
    return counts.source_stats(logs_of(spark, folder), COUNT_START, COUNT_END)


@query
def source_stats_rollup(spark, folder):
    return counts.source_stats_rollup(stats_of(spark, folder), COUNT_START, COUNT_END)


@query
def level_stats_rollup(spark, folder):
    return counts.level_stats_rollup(stats_of(spark, folder), COUNT_START, COUNT_END, "svc-1")


@query
def error_trends(spark, folder):
    return counts.error_trends(logs_of(spark, folder), "2023-12-28 00:00:00", COUNT_END)


@query
def error_trends_closed(spark, folder):
    logs = logs_of(spark, folder).withColumn("created_at", F.date_trunc("day", "created_at").cast("timestamp_ntz"))
    return counts.error_trends(logs, COUNT_START, COUNT_END, closed=True)


@query
def hourly_rollup(spark, folder):
    return stats_of(spark, folder)


@query
def increment_statistics(spark, folder):
    events = gappy_events(spark, folder).withColumnsRenamed({"logLevel": "log_level", "timestamp": "created_at"})
    return rollup.increment_statistics(events)


@query
def upsert_statistics(spark, folder):
    """The rollup of everything, raised by a second delivery of its errors."""
    logs = logs_of(spark, folder)
    errors = logs.filter(F.col("log_level") == "ERROR")
    return rollup.upsert_statistics(rollup.hourly_rollup(logs), rollup.hourly_rollup(errors))


@query
def upsert_stored_statistics(spark, folder):
    """Two loads into the stored rollup; the second is delivered twice and counts once."""
    path = scratch_path(spark, "statistics")
    logs = logs_of(spark, folder)
    errors = rollup.hourly_rollup(logs.filter(F.col("log_level") == "ERROR"))
    sinks.write_statistics(rollup.hourly_rollup(logs), path, "first")
    sinks.write_statistics(errors, path, "second")
    sinks.write_statistics(errors, path, "second")
    return sinks.read_statistics(spark, path)


@query
def rebuild_daily_statistics(spark, folder):
    """A stored rollup with double counts; one day of it is rebuilt from raw logs."""
    path = scratch_path(spark, "statistics")
    logs = logs_of(spark, folder)
    sinks.write_statistics(rollup.hourly_rollup(logs), path, "first")
    sinks.write_statistics(rollup.hourly_rollup(logs), path, "second")
    sinks.rebuild_statistics_day(logs, path, DAY)
    return sinks.read_statistics(spark, path)


@query
def replay_after_compaction(spark, folder):
    """Three loads; one day is compacted, then two loads are replayed and one comes late."""
    path = scratch_path(spark, "logs")
    logs = logs_of(spark, folder)
    for load in range(3):
        sinks.write_logs(logs.filter(F.col("id") % 4 == load), path, f"load-{load}")
    sinks.compact_day(spark, path, DAY, LOGS_SCHEMA)
    for load in (0, 2, 3):
        sinks.write_logs(logs.filter(F.col("id") % 4 == load), path, f"load-{load}")
    return sinks.read_logs(spark, path).groupBy("log_date", "log_level").agg(
        F.count("*").alias("logs"), F.count_distinct("id").alias("ids"))


@query
def two_streams_one_store(spark, folder):
    """Two consumers, each with its checkpoint, fill one store."""
    root = scratch_path(spark, "store")
    lines = logs_of(spark, folder).select(F.to_json(F.struct(
        "source", "content", F.col("log_level").alias("logLevel"), F.col("created_at").alias("timestamp"))).alias("value"),
        (F.col("id") % 2).alias("half"))
    for half in (0, 1):
        lines.filter(F.col("half") == half).select("value").write.text(f"{root}/in-{half}")
        consume.consume_events(event_sources.read_event_stream(spark, f"{root}/in-{half}"), root, f"{root}/state-{half}", AS_OF,
                               availableNow=True).awaitTermination()
    stored = sinks.read_logs(spark, f"{root}/logs").groupBy("source", "log_level").agg(F.count("*").alias("logs"))
    counted = sinks.read_statistics(spark, f"{root}/statistics").groupBy("source", "log_level").agg(
        F.sum("count").alias("counted"))
    return stored.join(counted, ["source", "log_level"])


@query
def equal_events_kept(spark, folder):
    """Each message delivered twice at positions of its own, and once more by a retry: rows, ids, equal ids."""
    lines = logs_of(spark, folder).select("id", F.to_json(F.struct(
        "source", "content", F.col("log_level").alias("logLevel"), F.col("created_at").alias("timestamp"))).alias("value"))
    sent = lines.select("value", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("copy"), "id").select(
        "value", F.concat_ws(":", F.lit("topic"), "copy", "id").alias("position"))
    stored = ingest.with_event_id(event_sources.decode_events(sent))
    return stored.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query
def reconcile_statistics(spark, folder):
    """A rollup that lost its warnings, doubled its errors and has one level too many."""
    logs = logs_of(spark, folder)
    stats = rollup.hourly_rollup(logs)
    level = F.col("log_level")
    drifted = stats.filter(level != "WARN").withColumns({
        "count": F.when(level == "ERROR", F.col("count") * 2).otherwise(F.col("count")),
        "log_level": F.when(level == "trace", "TRACE").otherwise(level)})
    return rollup.reconcile_statistics(drifted, logs)


@query
def reconcile_stored(spark, folder):
    """Three loads, one written twice, one of whose errors of one day never reached the rollup."""
    root, logs = scratch_path(spark, "store"), logs_of(spark, folder)
    for load in (0, 1, 2, 1):
        part = logs.filter(F.col("id") % 3 == load)
        lost = (F.to_date("created_at") == F.lit(DAY).cast("date")) & (F.col("log_level") == "ERROR") & F.lit(load == 1)
        sinks.write_logs(part, f"{root}/logs", f"load-{load}")
        sinks.write_statistics(rollup.hourly_rollup(part.filter(~lost)), f"{root}/statistics", f"load-{load}")
    return prints.reconcile_stored(spark, root, sinks.table_days(spark, f"{root}/logs"))


@query
def dashboard_stats(spark, folder):
    panels = dashboard.dashboard_stats(logs_of(spark, folder), COUNT_START, COUNT_END, as_of=STATUS_AS_OF, day=DAY,
                                       span=60)
    return dashboard.dashboard_flat(panels)


@query
def dashboard_status(spark, folder):
    return dashboard.status_panel(logs_of(spark, folder), STATUS_AS_OF, span=60)


@query
def level_counters(spark, folder):
    return counts.level_counters(logs_of(spark, folder))


@query
def minute_metrics(spark, folder):
    events = sources.table(spark, folder, "events")
    logs = events.select(F.col("ts").alias("created_at"), "value", F.col("event_type").alias("log_level"))
    return metrics.minute_metrics(logs, response="value")


@query
def rolling_metrics(spark, folder):
    events = sources.table(spark, folder, "events")
    logs = events.select(F.col("ts").alias("created_at"), "value", F.col("event_type").alias("log_level"))
    minutes = metrics.minute_metrics(logs, response="value")
    return metrics.rolling_metrics(metrics.fill_minutes(minutes, "2024-01-01 00:00:00", AS_OF))


@query
def rolling_metrics_by_service(spark, folder):
    events = sources.table(spark, folder, "events")
    logs = sources.logs_from_events(events)
    minutes = metrics.minute_metrics(logs, service="source").withColumn("avg_response_ms", F.lit(0).cast("long"))
    day = times.parse(f"{DAY} 00:00:00")
    filled = metrics.fill_minutes(minutes, day, day + timedelta(days=1))
    return metrics.rolling_metrics(filled, span=60)


@query
def current_metrics(spark, folder):
    return metrics.current_metrics(logs_of(spark, folder), "2024-01-15 12:34:56")


@query
def trailing_minute_metrics(spark, folder):
    return metrics.trailing_minute_metrics(logs_of(spark, folder), "2024-01-15 12:34:56", minutes=600)


@query
def compression_report(spark, folder):
    rows = doc_logs_of(spark, folder).withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"})
    stored = ingest.to_log_rows(rows, AS_OF)
    report = archive.compression_report(stored, "source", "log_level", subtotals=True)
    return report.select("source", "log_level", "total_logs", "compressed_logs", "original_bytes",
                         (F.col("stored_bytes") <= F.col("original_bytes") * 4 / 3).alias("never_larger"))


@query
def source_level_stats(spark, folder):
    return counts.source_level_stats(stats_of(spark, folder), COUNT_START, COUNT_END)


@query
def distinct_sources(spark, folder):
    return counts.distinct_sources(logs_of(spark, folder))


@query
def page_totals(spark, folder):
    return search.page_totals(search.search_logs(logs_of(spark, folder), level="WARN"), 20)


@query
def latency_summary(spark, folder):
    events = sources.table(spark, folder, "events")
    summary = metrics.latency_summary(events, "event_type", "value", F.col("value") > 100)
    digits = {"average": 6, "throughput": 9, "p50": 6, "p90": 6, "p95": 6, "p99": 6}
    return summary.withColumns({name: F.round(name, places) for name, places in digits.items()})


@query
def latency_summary_sketch(spark, folder):
    """The sketch's shares lie within a thousandth of the rows around the exact ones."""
    events = sources.table(spark, folder, "events")
    sketch = metrics.latency_summary(events, "event_type", "value", F.col("value") > 100, exact=False)
    names = {"p50": 0.5, "p99": 0.99}
    both = events.join(sketch.select(F.col("label").alias("event_type"), *names), "event_type")
    ranks = both.groupBy("event_type").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in names],
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in names])
    close = [((F.col(f"{p}_below") <= F.col("n") * (share + 0.001) + 1)
              & (F.col(f"{p}_upto") >= F.col("n") * (share - 0.001) - 1)).alias(f"{p}_close")
             for p, share in names.items()]
    return sketch.select("label", "samples", "minimum", "maximum").join(
        ranks.select(F.col("event_type").alias("label"), *close), "label")


@query
def latency_summary_nulls(spark, folder):
    """A label that is null, and one whose latencies all are."""
    kind = F.col("event_type")
    rows = sources.table(spark, folder, "events").select(
        F.when(kind != "view", kind).alias("label"), F.when(kind != "signup", F.col("value")).alias("latency"), "ts")
    summary = metrics.latency_summary(rows)
    return summary.select("label", "samples", "minimum", "maximum",
                          F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query
def rows_affected(spark, folder):
    """Rows that a counted write reports against the rows that are there afterwards."""
    path = scratch_path(spark, "logs")
    seen = sinks.counted_write(logs_of(spark, folder), sinks.write_logs, path)
    return sinks.read_logs(spark, path).agg(F.count("*").alias("stored")).withColumn("reported", F.lit(seen).cast("long"))


# --- windows ------------------------------------------------------------------------------------

@query
def repeated_error_candidates(spark, folder):
    return patterns.repeated_error_candidates(logs_of(spark, folder), REPEAT_THRESHOLD, REPEAT_WINDOW)


def offset_samples(spark, folder):
    """Cumulative event counts per type and source, one sample a minute with events."""
    minutes = (logs_of(spark, folder)
               .groupBy("log_level", "source", times.to_minute(F.col("created_at")).alias("ts"))
               .agg(F.count("*").alias("n")))
    upto = Window.partitionBy("log_level", "source").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return minutes.select("log_level", "source", "ts", F.sum("n").over(upto).alias("value"))


@query
def counter_rate(spark, folder):
    return metrics.counter_rate(offset_samples(spark, folder), ["log_level", "source"], ["log_level"],
                                3600).withColumn("rate", F.round("rate", 9))


@query
def counter_delta(spark, folder):
    return metrics.counter_rate(offset_samples(spark, folder), ["log_level", "source"],
                                ["log_level", "source"], 300).withColumn("rate", F.round("rate", 9))


@query
def gauge_delta(spark, folder):
    """Change of the number of events a minute."""
    minutes = (logs_of(spark, folder).groupBy("log_level", "source", times.to_minute(F.col("created_at")).alias("ts"))
               .agg(F.count("*").alias("value")))
    return metrics.gauge_delta(minutes, ["log_level", "source"], 3600)


@query
def consumer_lag(spark, folder):
    return metrics.latest_total(offset_samples(spark, folder), ["log_level", "source"], ["log_level"], name="lag")


@query
def running_count(spark, folder):
    return patterns.running_count(logs_of(spark, folder))


# --- sort, limit, paging ------------------------------------------------------------------------

@query
def recent_errors(spark, folder):
    return counts.recent_errors(logs_of(spark, folder))


@query
def recent_store_errors(spark, folder):
    """The newest errors of a store, with readable bodies, read from the newest days."""
    root = scratch_path(spark, "store")
    docs = doc_logs_of(spark, folder).withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"})
    sinks.write_logs(ingest.to_log_rows(docs, AS_OF), f"{root}/logs", "one")
    return searching.recent_store_errors(spark, root).select("id", "source", "content", "created_at")


@query
def page_logs(spark, folder):
    return search.page(logs_of(spark, folder), 3, 20, "created_at", "asc")


@query
def page_after(spark, folder):
    return search.page(logs_of(spark, folder), sort_by="source", direction="DESC", after=("svc-5", 5000))


@query
def page_after_nulls(spark, folder):
    """Pages among rows without a sort value, at their edge, and after them."""
    rows = gappy_events(spark, folder).select("id", "source")

    def cut(name: str, direction: str, after: tuple) -> DataFrame:
        found = search.page(rows, sort_by="source", direction=direction, after=after)
        return found.select(F.lit(name).alias("direction"), "id", "source")

    return (cut("desc", "desc", (None, 5000)).union(cut("desc edge", "desc", ("svc-0", 0)))
            .union(cut("asc", "asc", (None, 5000))))


@query
def top_sources(spark, folder):
    return counts.top_sources(stats_of(spark, folder), COUNT_START, COUNT_END)


@query
def related_logs(spark, folder):
    """Logs listed with each detection, newest first."""
    found = patterns.repeated_error(logs_of(spark, folder), REPEAT_THRESHOLD, REPEAT_WINDOW)
    return found.select(F.col("trigger_log.id").alias("trigger_id"),
                        F.posexplode("related_logs").alias("position", "log")).select(
        "trigger_id", F.col("position").cast("int").alias("position"), F.col("log.id").alias("id"))


# --- sets and tables ----------------------------------------------------------------------------

@query
def append_sources(spark, folder):
    events = wire_events(logs_of(spark, folder)).select("source", "content", "logLevel", "timestamp")
    lines = line_logs(spark, folder).select(F.lit("app.log").alias("source"), F.col("value").alias("content"))
    return ingest.append_sources(events, files.lines_to_events(lines))


@query
def log_history(spark, folder):
    logs = doc_logs_of(spark, folder)
    archived = archive.archive_logs(logs, "2024-01-01 12:00:00", 0)
    live = archive.expire_logs(logs, "2024-01-01 06:00:00", 0)
    return archive.log_history(live, archived).select("id", "source", "content", "log_level")


@query
def dedup_events(spark, folder):
    events = wire_events(logs_of(spark, folder)).drop("id")
    errors = events.filter(F.col("logLevel") == "ERROR")
    twice = ingest.with_event_id(ingest.append_sources(events, errors, errors))
    return ingest.dedup_events(twice).drop("id")


@query
def expire_logs(spark, folder):
    return archive.expire_logs(logs_of(spark, folder), AS_OF, RETENTION_DAYS)


@query
def expire_stored_logs(spark, folder):
    """Expiry of a stored table, with a cutoff in the middle of a day."""
    path = scratch_path(spark, "logs")
    sinks.write_logs(logs_of(spark, folder), path)
    removed = sinks.expire_table(spark, path, "2024-01-31 13:30:00", RETENTION_DAYS)
    return sinks.read_logs(spark, path).select("id", "created_at", F.lit(removed).cast("long").alias("removed"))


@query
def archive_logs(spark, folder):
    rows = archive.archive_logs(doc_logs_of(spark, folder), "2024-01-01 12:00:00", 0)
    readable = decompress(F.col("content"), F.col("compressed"))
    return rows.select("id", "source", readable.alias("content"), "log_level", "created_at", "archived_at")


@query
def archive_compress(spark, folder):
    docs = archive.with_storage_columns(doc_logs_of(spark, folder))
    packed = archive.archive_compress(docs)
    return packed.select("id", "original_size", "compressed_size", "compressed").join(
        docs.select("id", should_compress(F.col("content")).alias("eligible")), "id").select(
        "id", "original_size", "eligible",
        ((F.col("compressed_size") <= F.col("original_size"))
         & (F.col("eligible") | ~F.col("compressed"))).alias("never_larger"))


# --- streams and detectors ----------------------------------------------------------------------

@query
def ingest_events(spark, folder):
    """Defaults, route, enrichment, filter, publication, and back."""
    ready = ingest.ingest_events(gappy_events(spark, folder), AS_OF, "WARN", "svc-1")
    return event_sources.decode_events(messages.publish_events(ready))


@query
def consume_events(spark, folder):
    """Messages through the stream into the stored tables."""
    root = scratch_path(spark, "store")
    stream = event_sources.read_event_stream(spark, message_folder(spark, folder))
    consume.consume_events(stream, root, f"{root}/state", AS_OF, availableNow=True).awaitTermination()
    return sinks.read_logs(spark, f"{root}/logs").drop("id", "log_date")


@query
def consume_statistics(spark, folder):
    """The rollup that the same stream leaves behind."""
    root = scratch_path(spark, "store")
    stream = event_sources.read_event_stream(spark, message_folder(spark, folder))
    consume.consume_events(stream, root, f"{root}/state", AS_OF, availableNow=True).awaitTermination()
    return sinks.read_statistics(spark, f"{root}/statistics")


@query
def create_log(spark, folder):
    """Callers' rows straight to log rows: no defaults but the time, no filter."""
    events = ingest.with_event_id(gappy_events(spark, folder).drop("id"))
    return ingest.to_log_rows(events, AS_OF).drop("id", "log_date")


@query
def error_burst(spark, folder):
    return patterns.error_burst(logs_of(spark, folder), scope=None, **BURST)


@query
def error_burst_dense(spark, folder):
    return patterns.error_burst(logs_of(spark, folder), scope=None, **DENSE_BURST)


@query
def error_burst_by_source(spark, folder):
    return patterns.error_burst(logs_of(spark, folder), window_seconds=7200, threshold=3, cooldown_seconds=14400)


@query
def tumbling_burst(spark, folder):
    return patterns.windowed_burst(logs_of(spark, folder), "6 hours", 4)


@query
def sliding_burst(spark, folder):
    return patterns.windowed_burst(logs_of(spark, folder), "6 hours", 4, "1 hour")


@query
def repeated_error(spark, folder):
    return detection_summary(patterns.repeated_error(logs_of(spark, folder), REPEAT_THRESHOLD, REPEAT_WINDOW))


def detection_summary(found):
    return found.select(
        "pattern_id", "severity", "message", "detected_at", F.col("trigger_log.id").alias("trigger_id"),
        F.size("related_logs").alias("related"), F.col("additional_data.source").alias("source"),
        F.col("additional_data.message_pattern").alias("message_pattern"),
        F.col("additional_data.repeat_count").alias("repeat_count"))


@query
def pattern_alerts(spark, folder):
    known = [patterns.RepeatedErrorPattern(REPEAT_THRESHOLD, REPEAT_WINDOW),
             patterns.RepeatedErrorPattern(REPEAT_THRESHOLD, REPEAT_WINDOW, severity="INFO"),
             patterns.RepeatedErrorPattern(REPEAT_THRESHOLD, REPEAT_WINDOW, enabled=False)]
    return patterns.pattern_alerts(patterns.detect_patterns(logs_of(spark, folder), known))


def log_stream(spark, folder):
    """Logs as a stream of one file."""
    path = scratch_path(spark, "stream")
    logs = logs_of(spark, folder)
    logs.write.parquet(path)
    return spark.readStream.schema(logs.schema).parquet(path)


@query
def streaming_rollup(spark, folder):
    """Hourly counts that the watermark has closed: all but the newest hour."""
    out = scratch_path(spark, "rollup")
    consume.drain(rollup.streaming_rollup(log_stream(spark, folder), "0 seconds"), out, f"{out}-state")
    return spark.read.parquet(out)


@query
def streaming_minute_metrics(spark, folder):
    out = scratch_path(spark, "minutes")
    consume.drain(metrics.streaming_minute_metrics(log_stream(spark, folder), "0 seconds"), out, f"{out}-state")
    return spark.read.parquet(out)


@query
def streaming_error_burst(spark, folder):
    out = scratch_path(spark, "bursts")
    fired = detectors.stream_error_burst(log_stream(spark, folder), "0 seconds", scope=None, **BURST)
    consume.drain(fired, out, f"{out}-state")
    return spark.read.parquet(out)


@query
def streaming_repeated_error(spark, folder):
    out = scratch_path(spark, "repeats")
    found = detectors.stream_repeated_error(log_stream(spark, folder), "0 seconds",
                                            REPEAT_THRESHOLD, REPEAT_WINDOW)
    consume.drain(found, out, f"{out}-state")
    return detection_summary(spark.read.parquet(out))


def scattered_stream(spark, folder):
    """Logs in three micro-batches, each of them over the whole time, and a last log long after."""
    path = scratch_path(spark, "scattered")
    logs = logs_of(spark, folder)
    late = logs.filter("log_level = 'ERROR'").orderBy("id").limit(1).withColumns({
        "id": F.lit(-1).cast("long"), "source": F.lit("the end"),
        "created_at": F.col("created_at") + F.expr("INTERVAL 2000 DAYS")})
    for number, part in enumerate([*(logs.filter(F.col("id") % 3 == rest) for rest in (2, 0, 1)), late]):
        part.coalesce(1).write.parquet(f"{path}/part-{number}")
    return (spark.readStream.schema(logs.schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1).parquet(path))


@query
def streaming_error_burst_out_of_order(spark, folder):
    out = scratch_path(spark, "bursts")
    fired = detectors.stream_error_burst(scattered_stream(spark, folder), "1000 days", scope=None, hold=True, **BURST)
    consume.drain(fired, out, f"{out}-state")
    return spark.read.parquet(out)


@query
def streaming_repeated_error_out_of_order(spark, folder):
    out = scratch_path(spark, "repeats")
    found = detectors.stream_repeated_error(scattered_stream(spark, folder), "1000 days",
                                            REPEAT_THRESHOLD, REPEAT_WINDOW, hold=True)
    consume.drain(found, out, f"{out}-state")
    return detection_summary(spark.read.parquet(out))


@query
def streaming_level_counters(spark, folder):
    """Counters of a stream, as its last complete result."""
    out = scratch_path(spark, "counters")
    counters = counts.streaming_level_counters(log_stream(spark, folder))
    (counters.writeStream.outputMode("complete").trigger(availableNow=True)
     .option("checkpointLocation", f"{out}-state")
     .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination())
    return spark.read.parquet(out)


@query
def search_stored(spark, folder):
    """Search over stored tables, through the index because there is one."""
    root = scratch_path(spark, "store")
    docs = doc_logs_of(spark, folder)
    rows = ingest.to_log_rows(docs.withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"}), AS_OF)
    consume.store_batch(rows, root, "first", with_index=True)
    return searching.search_store(spark, root, keyword=DOC_KEYWORD, source="src1")


@query
def search_partly_indexed(spark, folder):
    """Two loads of a store, the second without an index."""
    root = scratch_path(spark, "store")
    docs = doc_logs_of(spark, folder)
    rows = ingest.to_log_rows(docs.withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"}), AS_OF)
    consume.store_batch(rows.filter("id % 2 = 0"), root, "first", with_index=True)
    consume.store_batch(rows.filter("id % 2 <> 0"), root, "second")
    return searching.search_store(spark, root, keyword=DOC_KEYWORD, source="src1")


def indexed_store(spark, folder, loads=2):
    """A store of document logs in some loads, all indexed."""
    root = scratch_path(spark, "store")
    docs = doc_logs_of(spark, folder)
    rows = ingest.to_log_rows(docs.withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"}), AS_OF)
    for load in range(loads):
        consume.store_batch(rows.filter(F.col("id") % loads == load), root, f"load-{load}", with_index=True)
    return root


@query
def search_one_day(spark, folder):
    """A search of two hours in an index of two loads, merged on the way; it reads the partitions that have hits."""
    root = indexed_store(spark, folder)
    index_sinks.merge_segments(spark, f"{root}/index", fanout=2)
    return searching.search_store(spark, root, keyword=DOC_KEYWORD, start="2024-01-01 01:00:00", end="2024-01-01 02:59:59")


@query
def search_damaged_index(spark, folder):
    """One load's postings are lost: its logs are searched instead, with the same result."""
    root = indexed_store(spark, folder)
    for bucket in range(8):
        index_sinks._delete(spark, f"{root}/index/terms/bucket={bucket}/segment=load-1")
    return searching.search_store(spark, root, keyword=DOC_KEYWORD)


@query
def expired_not_found(spark, folder):
    """Logs expired in the nightly run are not found any more, though their old load comes once again."""
    root = indexed_store(spark, folder)
    nightly.run_nightly(spark, root, "2024-01-31 01:30:00", 40, 30)
    docs = doc_logs_of(spark, folder)
    rows = ingest.to_log_rows(docs.withColumnsRenamed({"log_level": "logLevel", "created_at": "timestamp"}), AS_OF)
    consume.store_batch(rows.filter("id % 2 = 1"), root, "load-1", with_index=True)
    return searching.search_store(spark, root, keyword=DOC_KEYWORD)

"""The stored search index: documents by day and load, postings, vocabulary and n-grams in merged segments.

Nothing counts before its row is in the commit log. A row says in which segment a load's part lies now, and how many
files and bytes that segment has, so one log answers four questions: which loads are whole, where to look for them,
whether a file has been lost or cut since, and what a repeated load or an expired day has left.

A load writes one segment of each kind. As soon as ``FANOUT`` segments of one level have come, they are merged into one
of the next level, so their number grows with the logarithm of the loads. One process writes an index at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import tokens
from emberlog.functions.times import log_date, on, parse
from emberlog.operators.search import TERM_BUCKETS, SearchIndex, index_documents, index_grams, term_bucket
from emberlog.schemas import RETENTION_DAYS
from emberlog.sinks.tables import _folder, table_exists

FANOUT = 8
COMMITS = "_commits"
COMMIT_SCHEMA = """kind string, load string, log_date date, segment string, level int, files long, bytes long,
                   buckets int, at long"""
#: What a search can't do without; vocabulary and n-grams can be derived from postings.
NEEDED = ("documents", "terms")
#: Columns of a segment, the one it is bucketed by first.
SEGMENTS = {"terms": "term string, log_date date, load string, id string, bucket int, segment string",
            "words": "term string, bucket int, segment string",
            "grams": "gram string, term string, bucket int, segment string"}
DOCUMENTS = """id string, source string, content string, log_level string, timestamp timestamp_ntz, load string,
               log_date date, load_id string"""


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Where each load's part of each kind (and day, for documents) lies now."""
    folder = f"{path}/{COMMITS}"
    if not table_exists(spark, folder):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    rows = spark.read.schema(COMMIT_SCHEMA).parquet(folder)
    names = ["segment", "level", "files", "bytes", "buckets"]
    newest = F.max(F.struct("at", *names)).alias("now")
    return rows.groupBy("kind", "load", "log_date").agg(newest).select(
        "kind", "load", "log_date", *(F.col(f"now.{name}").alias(name) for name in names))


def _commit(rows: DataFrame, path: str) -> None:
    """One file makes all rows count at once."""
    rows.select("kind", "load", "log_date", "segment", "level", "files", "bytes", "buckets",
                F.lit(time.time_ns()).alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")


def stored_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, log_date, segment, found_files, found_bytes) as the folders have them; no file is opened."""
    folder = f"{path}/{kind}"
    if not table_exists(spark, folder):
        return spark.createDataFrame([], "kind string, log_date date, segment string, found_files long, found_bytes long")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    name = "load_id" if kind == "documents" else "segment"
    day = F.to_date(F.nullif(F.regexp_extract("path", "log_date=([^/]+)/", 1), F.lit("")))
    return listed.select(day.alias("log_date"), F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias("segment"),
                         "length").groupBy("log_date", "segment").agg(
        F.count("*").alias("found_files"), F.sum("length").alias("found_bytes")).select(
        F.lit(kind).alias("kind"), "log_date", "segment", "found_files", "found_bytes")


def healthy(spark: SparkSession, path: str, known: DataFrame | None = None, kinds=NEEDED) -> DataFrame:
    """Commits with ``intact``: whether the files of their segment are as many and as long as when they were written."""
    known = commits(spark, path) if known is None else known
    found = None
    for kind in kinds:
        part = stored_files(spark, path, kind)
        found = part if found is None else found.union(part)
    known = known.filter(F.col("kind").isin(*kinds)).alias("c")
    found = found.alias("f")
    same = ((F.col("c.kind") == F.col("f.kind")) & (F.col("c.segment") == F.col("f.segment"))
            & F.col("c.log_date").eqNullSafe(F.col("f.log_date")))
    return known.join(found, same, "left").select("c.*", (
        (F.col("files") == F.coalesce("found_files", F.lit(0)))
        & (F.col("bytes") == F.coalesce("found_bytes", F.lit(0)))).alias("intact"))


def _states(spark: SparkSession, path: str) -> DataFrame:
    return healthy(spark, path).groupBy("load").agg(F.min("intact").alias("intact"))


def indexed_loads(spark: SparkSession, path: str) -> DataFrame | None:
    """(load_id) of the loads that are wholly in the index and whose files are as they were written; none without index."""
    if not table_exists(spark, f"{path}/{COMMITS}"):
        return None
    return _states(spark, path).filter("intact").select(F.col("load").alias("load_id"))


def _write_segment(rows: DataFrame, path: str, kind: str, segment: str, buckets: int, *sort: str,
                   same: dict | None = None) -> None:
    """What is equal in all rows comes behind the sort, so that it is neither shuffled nor sorted."""
    column = SEGMENTS[kind].split()[0]
    (rows.withColumn("bucket", term_bucket(F.col(column), buckets))
     .hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", column, *sort)
     .withColumns({**(same or {}), "segment": F.lit(segment)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "segment").parquet(f"{path}/{kind}"))


def _segments(spark: SparkSession, path: str, kind: str, segments: list[str]) -> DataFrame:
    """Rows of the named segments. There are a few a level, so their names prune folders."""
    if not segments:
        return spark.createDataFrame([], SEGMENTS[kind])
    return spark.read.schema(SEGMENTS[kind]).parquet(f"{path}/{kind}").filter(F.col("segment").isin(*segments))


def live_segments(spark: SparkSession, path: str, known: DataFrame | None = None, load: str | None = None) -> list:
    """(kind, segment, level, buckets, mine) of segments, at most ``FANOUT`` a kind and level but for a merge that is
    due; ``mine`` tells those that hold something of ``load``. Documents count as one."""
    known = commits(spark, path) if known is None else known
    segment = F.when(F.col("kind") != "documents", F.col("segment")).otherwise("")
    return known.groupBy("kind", segment.alias("segment")).agg(
        F.max("level").alias("level"), F.max("buckets").alias("buckets"),
        F.max(F.col("load").eqNullSafe(F.lit(load))).alias("mine")).orderBy("kind", "level", "segment").collect()


def _damaged(spark: SparkSession, path: str, known: DataFrame, kinds: tuple[str, ...]) -> list:
    """(kind, log_date, segment) of segments with missing or cut files: none, unless something has gone wrong."""
    return healthy(spark, path, known, kinds).filter("NOT intact").select("kind", "log_date", "segment").distinct().collect()


def _sizes(spark: SparkSession, path: str, kind: str, segment: str) -> dict:
    """Files and bytes of one segment as literals, zeros where it has none."""
    row = stored_files(spark, path, kind).filter(F.col("segment") == segment).agg(
        F.sum("found_files").alias("files"), F.sum("found_bytes").alias("bytes")).first()
    return {name: F.lit(row[name] or 0).cast("long") for name in ("files", "bytes")}


def index_logs(logs: DataFrame, path: str, load_id: str | None = None, with_ngrams: bool = True,
               buckets: int | None = None, fanout: int = FANOUT) -> str:
    """Add readable logs to the search index. A load that is in there changes nothing, unless its files have been
    damaged; then what it wrote itself is written again. ``buckets`` counts for the first load only."""
    spark = logs.sparkSession
    load = load_id or uuid.uuid4().hex
    known = commits(spark, path)
    live = live_segments(spark, path, known, load)
    if any(row.mine for row in live) and _states(spark, path).filter((F.col("load") == load) & F.col("intact")).take(1):
        return load
    count = max((row.buckets for row in live), default=buckets or TERM_BUCKETS)
    documents = index_documents(logs.withColumn("log_date", log_date(F.col("created_at"))))
    (documents.withColumns({"load": F.lit(load), "load_id": F.lit(load)}).hint("rebalance", F.col("log_date"))
     .sortWithinPartitions("log_date", "timestamp").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "load_id").parquet(f"{path}/documents"))
    stored = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents").filter(F.col("load_id") == load)
    postings = stored.select("log_date", "id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    _write_segment(postings, path, "terms", load, count, "log_date", same={"load": F.lit(load)})
    kinds = ["terms"]
    if with_ngrams:
        kinds += ["words", "grams"]
        before = [row.segment for row in live if row.kind == "words" and row.segment != load]
        words = _segments(spark, path, "terms", [load]).select("term").distinct()
        words = words.join(_segments(spark, path, "words", before).select("term"), "term", "left_anti")
        _write_segment(words, path, "words", load, count)
        _write_segment(index_grams(_segments(spark, path, "words", [load])), path, "grams", load, count)
    whole = stored_files(spark, path, "documents")
    for kind in kinds:
        whole = whole.union(stored_files(spark, path, kind))
    whole = whole.filter(F.col("segment") == load).select("kind", "log_date", "found_files", "found_bytes")
    for kind in kinds:  # where a load has no words, it still has a row
        none = spark.createDataFrame([(kind, None, 0, 0)], whole.schema)
        whole = whole.union(none)
    _commit(whole.groupBy("kind", "log_date").agg(F.sum("found_files").alias("files"), F.sum("found_bytes").alias("bytes"))
            .withColumns({"load": F.lit(load), "segment": F.lit(load), "level": F.lit(0), "buckets": F.lit(count)}), path)
    levels = [(row.kind, row.level) for row in live if row.segment != load] + [(kind, 0) for kind in kinds]
    if any(levels.count(at) >= fanout for at in levels if at[0] != "documents"):
        merge_segments(spark, path, fanout)
    return load


def merge_segments(spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
    """Merge the segments of every kind and level that has ``fanout`` of them. Readers see the old ones until the new
    one is committed; postings of days that have left the index stay behind. A damaged segment is not merged."""
    skipped: set[tuple[str, str]] = set()
    while True:
        levels: dict[tuple[str, int], list[str]] = {}
        for row in live_segments(spark, path):
            if row.kind != "documents" and (row.kind, row.segment) not in skipped:
                levels.setdefault((row.kind, row.level), []).append(row.segment)
        due = next((at for at, names in sorted(levels.items()) if len(names) >= fanout), None)
        if due is None:
            return
        (kind, level), names, known = due, levels[due], commits(spark, path)
        damaged = {(row.kind, row.segment) for row in _damaged(spark, path, known, (kind,))} - skipped
        if damaged:
            skipped |= damaged
            continue
        merged, count = f"merged-{uuid.uuid4().hex}", table_buckets(spark, path)
        rows = _segments(spark, path, kind, names).drop("bucket", "segment")
        if kind == "terms":
            days = known.filter("kind = 'documents' AND segment <> ''").select("log_date").distinct()
            rows = rows.join(F.broadcast(days), "log_date", "left_semi")
        _write_segment(rows, path, kind, merged, count, *(["log_date"] if kind == "terms" else []))
        inside = known.filter((F.col("kind") == kind) & F.col("segment").isin(*names))
        _commit(inside.withColumns({"segment": F.lit(merged), "level": F.lit(level + 1),
                                    **_sizes(spark, path, kind, merged)}), path)
        for bucket in range(count):
            for name in names:
                _delete(spark, f"{path}/{kind}/bucket={bucket}/segment={name}")


def table_buckets(spark: SparkSession, path: str) -> int:
    """Buckets of the index, as its first load set them."""
    return commits(spark, path).agg(F.max("buckets")).first()[0] or TERM_BUCKETS


def _delete(spark: SparkSession, path: str) -> None:
    filesystem, folder = _folder(spark, path)
    filesystem.delete(folder, True)
    spark.catalog.refreshByPath(path)


def read_index(spark: SparkSession, path: str, loads: DataFrame | None = None) -> SearchIndex:
    """The stored index, or of it the documents of ``loads``, without segments that are damaged. Loads whose n-grams
    were not stored get them from their terms, when asked for; so do all, where a stored n-gram file is damaged."""
    known = commits(spark, path)
    damaged = _damaged(spark, path, known, (*NEEDED, "words", "grams"))
    bad = {kind: {row.segment for row in damaged if row.kind == kind} for kind in (*NEEDED, "words", "grams")}
    places = known.filter((F.col("kind") == "documents") & ~F.col("segment").isin("", *bad["documents"])).select(
        "load", "log_date", F.col("segment").alias("load_id"))
    if loads is not None:
        places = places.join(loads.select(F.col("load_id").alias("load")), "load", "left_semi")
    documents = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents")
    if bad["documents"]:
        documents = documents.filter(~F.col("load_id").isin(*bad["documents"]))
    documents = documents.join(F.broadcast(places), ["load", "log_date", "load_id"], "left_semi").drop("load")
    live = {kind: [] for kind in SEGMENTS}
    segments = live_segments(spark, path, known)
    for row in segments:
        if row.kind in live and row.segment not in bad[row.kind]:
            live[row.kind].append(row.segment)
    terms = _segments(spark, path, "terms", live["terms"]).drop("segment")
    count = max((row.buckets for row in segments), default=TERM_BUCKETS)
    if bad["words"] or bad["grams"]:
        grams, bare = _segments(spark, path, "grams", []), terms
    else:
        grams = _segments(spark, path, "grams", live["grams"])
        without = known.filter("kind = 'terms'").join(known.filter("kind = 'grams'"), "load", "left_anti").select("load")
        # Postings are read for n-grams only where a load has none.
        bare = terms.join(F.broadcast(without), "load", "left_semi") if without.take(1) else None
    grams = grams.select("gram", "term", "bucket")
    if bare is not None:
        grams = grams.unionByName(index_grams(bare).select("gram", "term", term_bucket(F.col("gram"), count).alias("bucket")))
    return SearchIndex(documents.select("id", "source", "content", "log_level", "timestamp", "log_date", "load_id"), terms,
                       grams, places, count)


def rewrite_day(spark: SparkSession, path: str, day: date, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Put a day's documents, or those that ``keep`` leaves of them, into one segment; ``keep`` may leave none.
    Damaged segments stay as they are: their loads are searched in the logs."""
    known = commits(spark, path)
    bad = [row.segment for row in _damaged(spark, path, known, ("documents",))]
    now = known.filter((F.col("kind") == "documents") & (F.col("log_date") == on(day)) & ~F.col("segment").isin("", *bad))
    names = [row.segment for row in now.select("segment").distinct().collect()]
    if not names:
        return
    rows = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents").filter(
        (F.col("log_date") == on(day)) & F.col("load_id").isin(*names)).join(
        F.broadcast(now.select("load", F.col("segment").alias("load_id"))), ["load", "load_id"], "left_semi")
    merged = f"merged-{uuid.uuid4().hex}"
    (keep(rows).withColumn("load_id", F.lit(merged)).hint("rebalance", F.col("log_date")).sortWithinPartitions("timestamp")
     .write.mode("append").partitionBy("log_date", "load_id").parquet(f"{path}/documents"))
    _commit(now.withColumns({"segment": F.lit(merged), "level": F.col("level") + 1,
                             **_sizes(spark, path, "documents", merged)}), path)
    for name in names:
        _delete(spark, f"{path}/documents/log_date={day}/load_id={name}")


def index_days(spark: SparkSession, path: str) -> dict[date, int]:
    """Days of the index and how many segments hold their documents."""
    now = commits(spark, path).filter("kind = 'documents' AND segment <> ''")
    return {row.log_date: row.n for row in now.groupBy("log_date").agg(F.count_distinct("segment").alias("n")).collect()}


def expire_index(spark: SparkSession, path: str, as_of: datetime | str, days: int = RETENTION_DAYS,
                 logs: DataFrame | None = None) -> None:
    """Take documents older than ``days`` before ``as_of`` out of the index.

    Whole days leave a tombstone for each of their loads, so a repeated load stays away. Of the day the cutoff falls
    in, the documents of the ``logs`` that are not older stay; without logs, those that are not older by the second.
    """
    cutoff = parse(as_of) - timedelta(days=days)
    old = [day for day in index_days(spark, path) if day < cutoff.date()]
    if old:
        gone = commits(spark, path).filter((F.col("kind") == "documents") & F.col("log_date").isin(old))
        _commit(gone.withColumns({"segment": F.lit(""), "level": F.col("level") + 1, "files": F.lit(0).cast("long"),
                                  "bytes": F.lit(0).cast("long")}), path)
        for day in old:
            _delete(spark, f"{path}/documents/log_date={day}")
    if cutoff.date() not in index_days(spark, path):
        return
    second = F.lit(cutoff.replace(microsecond=0)).cast("timestamp_ntz")
    if logs is None:
        rewrite_day(spark, path, cutoff.date(), lambda rows: rows.filter(F.col("timestamp") >= second))
        return
    kept = logs.filter((F.col("log_date") == on(cutoff.date())) & (F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz")))
    rewrite_day(spark, path, cutoff.date(),
                lambda rows: rows.join(kept.select(F.col("id").cast("string").alias("id")), "id", "left_semi"))

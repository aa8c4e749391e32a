"""Service metrics: per-minute series, rolling means, counters, lag and latency."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import is_error, system_status
from emberlog.functions.measures import error_rate
from emberlog.functions.times import (MICROS, at, from_micros, instant, micros, parse, to_minute,
                                     wall_time)
from emberlog.operators.ordered import KEY, range_ordered, row_key, running_total
from emberlog.sources.tables import between_closed

MINUTE_US = 60 * MICROS
# The shares reported for latencies, and the minutes of the rolling mean.
LATENCY_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
ROLLING_MINUTES = 5
TRAILING_MINUTES = 10


def minute_metrics(logs: DataFrame, response: str | None = None,
                   service: str | None = None) -> DataFrame:
    """Processed logs, errors and mean response (whole ms) per minute and, if given, per service."""
    groups = [to_minute(F.col("created_at")).alias("minute")]
    if service:
        groups.insert(0, F.col(service).alias("service"))
    measures = [F.count("*").alias("processed"), F.count_if(is_error(F.col("log_level"))).alias("errors")]
    if response:
        measures.append(F.coalesce(F.floor(F.sum(F.floor(response)) / F.count(response)), F.lit(0))
                        .cast("long").alias("avg_response_ms"))
    return logs.groupBy(*groups).agg(*measures)


def fill_minutes(minutes: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """The series with a zero row for every empty minute from ``start`` up to ``end``, not included."""
    last = parse(end) - timedelta(minutes=1)
    each_minute = F.explode(F.sequence(at(start), at(last), F.expr("INTERVAL 1 MINUTE")))
    values = [c for c in minutes.columns if c not in ("service", "minute")]
    if "service" in minutes.columns:
        keys = ["service", "minute"]
        spine = minutes.select("service").distinct().select("service", each_minute.alias("minute"))
    else:
        keys = ["minute"]
        spine = minutes.sparkSession.range(1).select(each_minute.alias("minute"))
    zeros = spine.select(*keys, *[F.lit(0).cast("long").alias(c) for c in values])
    bounded = minutes.filter((F.col("minute") >= at(start)) & (F.col("minute") < at(end)))
    return (bounded.unionByName(zeros.select(*bounded.columns)).groupBy(*keys)
            .agg(*[F.sum(c).alias(c) for c in values]))


def rolling_metrics(minutes: DataFrame, span: int = ROLLING_MINUTES) -> DataFrame:
    """Means over the last ``span`` minutes of a gap-free minute series, and the status they mean.

    The window runs over minutes, not over logs: 1,440 rows a day and service.
    """
    partition = ["service"] if "service" in minutes.columns else [F.lit(0)]
    frame = Window.partitionBy(*partition).orderBy("minute").rowsBetween(1 - span, 0)
    processed, errors = F.sum("processed").over(frame), F.sum("errors").over(frame)
    timed = F.when(F.col("avg_response_ms") > 0, F.col("avg_response_ms"))
    response = F.coalesce(F.floor(F.sum(timed).over(frame) / F.count(timed).over(frame)), F.lit(0))
    rolled = minutes.withColumns({
        "processed_rate": F.floor(processed / F.lit(span)).cast("long"),
        "error_rate": error_rate(errors, processed),
        "avg_response_time": response.cast("long"),
    })
    keys = [c for c in ("service", "minute") if c in minutes.columns]
    return rolled.select(*keys, "processed_rate", "error_rate", "avg_response_time",
                         system_status(F.col("error_rate"), F.col("avg_response_time")).alias("status"))


def current_metrics(logs: DataFrame, as_of: datetime | str, response: str | None = None) -> DataFrame:
    """Rate, error rate and mean response of the minute in progress at ``as_of``; always one row."""
    now = parse(as_of)
    started = now.replace(second=0, microsecond=0)
    rows = between_closed(logs, started, now)
    measured = rows.agg(
        F.count("*").alias("processed_rate"),
        F.count_if(is_error(F.col("log_level"))).alias("errors"),
        (F.coalesce(F.floor(F.sum(F.floor(response)) / F.count(response)), F.lit(0)).cast("long")
         if response else F.lit(0).cast("long")).alias("avg_response_time"))
    return measured.select("processed_rate",
                           error_rate(F.col("errors"), F.col("processed_rate")).alias("error_rate"),
                           "avg_response_time")


def trailing_minute_metrics(logs: DataFrame, as_of: datetime | str,
                            minutes: int = TRAILING_MINUTES, closed: bool = True) -> DataFrame:
    """Logs and errors of the ``minutes`` one-minute buckets that end at ``as_of``; bucket 0 is last.

    ``closed`` counts a row exactly between two buckets in both.
    """
    end = parse(as_of)
    rows = between_closed(logs, end - timedelta(minutes=minutes), end)
    age = micros(at(end)) - micros(F.col("created_at"))
    own = F.floor(age / F.lit(MINUTE_US)).cast("int")
    buckets = F.array(own)
    if closed:
        buckets = F.when(age % MINUTE_US == 0, F.array(own - 1, own)).otherwise(buckets)
    counted = (rows.select("log_level", F.explode(buckets).alias("bucket"))
               .filter(F.col("bucket").between(0, minutes - 1)).groupBy("bucket")
               .agg(F.count("*").alias("processed"),
                    F.count_if(F.col("log_level") == "ERROR").alias("errors")))
    spine = logs.sparkSession.range(minutes).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counted, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("processed", "errors")])


def streaming_minute_metrics(logs: DataFrame, delay: str) -> DataFrame:
    """``minute_metrics`` of a stream; a minute is emitted once the watermark has passed it."""
    counted = (logs.withColumn("at", instant(F.col("created_at"))).withWatermark("at", delay)
               .groupBy(F.window("at", "1 minute").alias("span"))
               .agg(F.count("*").alias("processed"),
                    F.count_if(is_error(F.col("log_level"))).alias("errors")))
    return counted.select(wall_time(F.col("span.start")).alias("minute"), "processed", "errors")


def counter_increase(samples: DataFrame, series: list[str], window_seconds: int,
                     per_seconds: int = 60, value: str = "value", ts: str = "ts") -> DataFrame:
    """Increase of cumulative counters since the window before that has samples, scaled to ``per_seconds``.

    Per series and window the last sample counts; a counter that fell was reset and has grown from zero.
    After a gap the increase is spread over the windows it took. Only one row per window reaches the
    ordered step, however many samples a series has.
    """
    change, before = F.col("closing") - F.col("closing_before"), F.col("closing_before")
    grown = F.when(change < 0, F.col("closing")).otherwise(change)
    seconds = (F.col("bucket") - F.col("bucket_before")) * F.lit(float(window_seconds))
    return _closing_values(samples, series, window_seconds, value, ts).filter(before.isNotNull()).select(
        *series, from_micros(F.col("bucket") * (window_seconds * MICROS)).alias("window_start"),
        (grown * F.lit(float(per_seconds)) / seconds).alias("rate"))


def gauge_delta(samples: DataFrame, series: list[str], window_seconds: int, value: str = "value",
                ts: str = "ts") -> DataFrame:
    """Change of a gauge since the window before that has samples; it may fall."""
    return _closing_values(samples, series, window_seconds, value, ts).filter(
        F.col("closing_before").isNotNull()).select(
        *series, from_micros(F.col("bucket") * (window_seconds * MICROS)).alias("window_start"),
        (F.col("closing") - F.col("closing_before")).alias("delta"))


def _closing_values(samples: DataFrame, series: list[str], window_seconds: int, value: str, ts: str) -> DataFrame:
    """Last value of every window with samples, next to that of the one before."""
    bucket = F.floor(micros(F.col(ts)) / F.lit(window_seconds * MICROS))
    closing = (samples.groupBy(*series, bucket.alias("bucket"))
               .agg(F.max_by(value, ts).alias("closing")))
    order = Window.partitionBy(*series).orderBy("bucket")
    return closing.withColumns({"closing_before": F.lag("closing").over(order),
                                "bucket_before": F.lag("bucket").over(order)})


def counter_rate(samples: DataFrame, series: list[str], by: list[str], window_seconds: int,
                 per_seconds: int = 60, value: str = "value", ts: str = "ts") -> DataFrame:
    """``counter_increase`` summed over the series that share the labels ``by``."""
    grown = counter_increase(samples, series, window_seconds, per_seconds, value, ts)
    return grown.groupBy(*by, "window_start").agg(F.sum("rate").alias("rate"))


def latest_total(samples: DataFrame, series: list[str], by: list[str], value: str = "value",
                 ts: str = "ts", name: str = "total") -> DataFrame:
    """Latest sample of every series, summed by labels: consumer lag, partition counts."""
    latest = samples.groupBy(*series).agg(F.max_by(value, ts).alias("latest"))
    return latest.groupBy(*by).agg(F.sum("latest").alias(name))


def latency_summary(requests: DataFrame, label: str = "label", latency: str = "latency",
                    failed: Column | None = None, ts: str = "ts", exact: bool = True) -> DataFrame:
    """Count, mean, p50/p90/p95/p99, min, max, error percent and requests per second per label.

    ``exact`` interpolates between ranked values; otherwise fixed-size sketches are merged.
    """
    bad = failed if failed is not None else F.lit(False)
    rows = requests.select(F.col(label).alias("label"), F.col(latency).alias("latency"),
                           F.col(ts).alias("ts"), bad.alias("failed"))
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / F.lit(float(MICROS))
    measures = [
        F.count("*").alias("samples"), F.avg("latency").alias("average"),
        F.min("latency").alias("minimum"), F.max("latency").alias("maximum"),
        error_rate(F.count_if("failed"), F.count("*")).alias("error_percent"),
        F.when(span > 0, F.count("*") / span).alias("throughput")]
    if not exact:
        measures += [F.percentile_approx("latency", share, 10000).alias(name)
                     for name, share in LATENCY_SHARES.items()]
        return rows.groupBy("label").agg(*measures)
    summary = rows.groupBy("label").agg(*measures)
    shares = _exact_shares(rows).withColumnRenamed("label", "_label")
    return summary.join(shares, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def _exact_shares(rows: DataFrame) -> DataFrame:
    """Interpolated shares from a running count over the distinct latencies of each label."""
    counted = (rows.filter(F.col("latency").isNotNull())
               .groupBy("label", "latency").agg(F.count("*").alias("n"))
               .withColumn(KEY, row_key("label")))
    ranked = running_total(range_ordered(counted, "latency"), "n", "upto", "latency")
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    # Value at zero-based rank r: the one whose ranks [upto - n, upto) contain r.
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    shares = []
    for name, share in LATENCY_SHARES.items():
        rank = F.lit(share) * (F.col("total") - 1)
        low = F.max(F.when((first <= F.floor(rank)) & (last >= F.floor(rank)), F.col("latency")))
        high = F.max(F.when((first <= F.ceil(rank)) & (last >= F.ceil(rank)), F.col("latency")))
        part = F.max(rank - F.floor(rank))
        shares.append((low + (high - low) * part).alias(name))
    totals = totals.withColumnRenamed("label", "_label")
    return ranked.join(totals, F.col("label").eqNullSafe(F.col("_label"))).groupBy("label").agg(*shares)

from datetime import datetime

from pyspark.sql import functions as F

from emberlog.operators import counts, metrics, rollup
from emberlog.plans.dashboard import dashboard_flat, dashboard_stats

DAY = "2024-01-02"


def edge_logs(logs):
    return logs((1, "a", "x", "ERROR", "2024-01-02 00:00:00"), (2, "a", "x", "WARN", "2024-01-02 01:00:00"),
                (3, "b", "x", "odd", "2024-01-02 01:30:00"), (4, "b", "x", "error", "2024-01-02 23:59:59.999999"),
                (5, "c", "x", "ERROR", "2024-01-03 00:00:00"))


def test_counts_in_a_closed_range(logs):
    row = counts.log_counts(edge_logs(logs), "2024-01-02 00:00:00", "2024-01-03 00:00:00").first()
    assert tuple(row) == (2, 1, 0, 0, 5, 40.0)
    assert tuple(counts.log_counts(edge_logs(logs), "2030-01-01 00:00:00", "2030-01-02 00:00:00").first()) == (0, 0, 0, 0, 0, 0.0)


def test_source_is_matched_literally(logs):
    rows = logs((1, "a_b", "x", "INFO", "2024-01-02 00:00:00"), (2, "axb", "x", "INFO", "2024-01-02 00:00:00"),
                (3, "A_B", "x", "INFO", "2024-01-02 00:00:00"))
    assert counts.log_counts(rows, "2024-01-01 00:00:00", "2024-01-03 00:00:00", "a_b").first().total == 1


def test_hours_half_open_and_closed(logs):
    half = {r.hour: r for r in counts.hourly_stats(edge_logs(logs), DAY).collect()}
    closed = {r.hour: r for r in counts.hourly_stats(edge_logs(logs), DAY, closed=True).collect()}
    assert len(half) == len(closed) == 24
    assert (half["00:00"].error, half["00:00"].warn, half["01:00"].warn, half["23:00"].error) == (1, 0, 1, 0)
    assert (closed["00:00"].error, closed["00:00"].warn, closed["01:00"].warn, closed["23:00"].error) == (1, 1, 1, 1)
    assert half["01:00"].total == 1      # the unknown level is left out


def test_days_half_open_and_closed(logs):
    half = {str(r.log_date): r for r in counts.error_trends(edge_logs(logs), "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()}
    closed = {str(r.log_date): r for r in counts.error_trends(edge_logs(logs), "2024-01-01 00:00:00", "2024-01-02 00:00:00", closed=True).collect()}
    assert [half[d].total_logs for d in sorted(half)] == [0, 4]
    assert [closed[d].total_logs for d in sorted(closed)] == [1, 5]
    assert closed[DAY].error_rate == 40.0


def test_rollup_panels_add_levels_of_any_case(logs):
    stats = rollup.hourly_rollup(edge_logs(logs))
    row = counts.log_counts_rollup(stats, "2024-01-02 10:00:00", "2024-01-03 10:00:00").first()
    assert (row.error, row.total) == (3, 5)
    hours = {r.hour: r for r in counts.hourly_stats_rollup(stats, DAY).collect()}
    assert (hours["23:00"].error, hours["23:00"].total, hours["01:00"].total) == (0, 1, 2)
    assert [tuple(r) for r in counts.top_sources(stats, DAY, DAY, 1).collect()] == [("a", 2)]


def test_rollup_keeps_null_keys_together(logs):
    rows = logs((1, None, "x", "INFO", "2024-01-02 00:00:00"), (2, None, "x", "INFO", "2024-01-02 00:10:00"))
    delta = rollup.hourly_rollup(rows)
    assert rollup.upsert_statistics(delta, delta).first()["count"] == 4
    assert rollup.increment_statistics(rows).count() == 0
    assert [r.status for r in rollup.reconcile_statistics(delta, rows).collect()] == ["match"]


def test_rollup_sums_to_the_raw_count(logs):
    assert rollup.hourly_rollup(edge_logs(logs)).agg(F.sum("count")).first()[0] == 5


def test_recent_errors_break_ties_by_id(logs):
    rows = logs(*[(i, "a", "x", "ERROR", "2024-01-02 00:00:00") for i in range(8)])
    assert [r.id for r in counts.recent_errors(rows).collect()] == [7, 6, 5, 4, 3]


def test_level_share_leaves_out_empty_slices(logs):
    panel = counts.level_share(counts.log_counts(edge_logs(logs), "2024-01-02 00:00:00", "2024-01-03 00:00:00"))
    assert sorted(tuple(r) for r in panel.collect()) == [("ERROR", 2, 67), ("WARN", 1, 33)]


def test_trailing_buckets_share_their_bounds(logs):
    rows = logs((1, "a", "x", "ERROR", "2024-01-02 00:09:00"), (2, "a", "x", "INFO", "2024-01-02 00:09:30"),
                (3, "a", "x", "INFO", "2024-01-02 00:10:00"), (4, "a", "x", "INFO", "2024-01-02 00:00:00"))
    found = {r.bucket: (r.processed, r.errors) for r in metrics.trailing_minute_metrics(rows, "2024-01-02 00:10:00").collect()}
    assert (found[0], found[1], found[9], len(found)) == ((3, 1), (1, 1), (1, 0), 10)
    halves = metrics.trailing_minute_metrics(rows, "2024-01-02 00:10:00", closed=False)
    assert sum(r.processed for r in halves.collect()) == 3


def test_rolling_means_use_empty_minutes(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0), 10, 1, 40), (datetime(2024, 1, 1, 0, 3), 7, 1, 0)],
                                 "minute timestamp_ntz, processed long, errors long, avg_response_ms long")
    filled = metrics.fill_minutes(rows, "2024-01-01 00:00:00", "2024-01-01 00:07:00")
    found = {r.minute.minute: r for r in metrics.rolling_metrics(filled).collect()}
    assert len(found) == 7 and (found[3].processed_rate, found[3].error_rate) == (3, 11.76)
    assert (found[3].avg_response_time, found[5].processed_rate, found[5].avg_response_time) == (40, 1, 0)


def test_counter_reset_starts_from_zero(spark):
    rows = spark.createDataFrame([("t", datetime(2024, 1, 1, 0, m), v) for m, v in ((0, 10), (1, 25), (2, 5), (3, 8))],
                                 "topic string, ts timestamp_ntz, value long")
    rates = [r.rate for r in metrics.counter_rate(rows, ["topic"], ["topic"], 60).orderBy("window_start").collect()]
    assert rates == [15.0, 5.0, 3.0]


def test_exact_latency_shares_on_a_hot_label(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 60, 900)]
    rows = spark.createDataFrame([("hot", v, datetime(2024, 1, 1, 0, 0, i % 60)) for i, v in enumerate(values)]
                                 + [("one", 5.0, datetime(2024, 1, 1))], "label string, latency double, ts timestamp_ntz")
    found = {r.label: r for r in metrics.latency_summary(rows).collect()}
    for name, share in metrics.LATENCY_SHARES.items():
        assert abs(found["hot"][name] - np.quantile(values, share)) < 1e-9
        assert found["one"][name] == 5.0
    assert found["one"].throughput is None


def test_dashboard_panels(logs):
    rows = edge_logs(logs)
    stats = rollup.hourly_rollup(rows)
    panels = dashboard_stats(rows, end="2024-01-03 00:00:00", stats=stats)
    assert panels["log_counts"].first().total == 5
    assert panels["error_trends"].count() == 9
    # One log, an error, in the five minutes before the end.
    assert panels["system_status"].first().status == "DEGRADED"
    flat = dashboard_flat(panels)
    assert flat.columns == ["panel", "key", "metric", "value"]
    assert flat.filter("panel = 'hourly_stats'").count() == 24 * 5

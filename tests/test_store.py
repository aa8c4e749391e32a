import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from emberlog.operators import archive, rollup
from emberlog.plans.nightly import run_archive, run_nightly, unarchived_days
from emberlog.schemas import LOGS_SCHEMA, STATISTICS_SCHEMA
from emberlog.sinks import messages, prints, tables


def month(logs):
    return logs(*[(i, f"s{i % 3}", "body " * (400 if i % 5 == 0 else 1), "INFO", datetime(2024, 1, 1 + i % 20, i % 24))
                  for i in range(200)])


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def test_a_repeated_load_counts_once(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    tables.write_logs(month(logs), path, "one")
    tables.write_logs(month(logs), path, "one")
    tables.write_logs(logs((999, "s", "x", "INFO", "2024-01-01 00:00:00")), path, "two")
    stored = tables.read_logs(spark, path)
    assert ids(stored) == list(range(200)) + [999]
    assert stored.filter("id = 3").first().compressed is False


def test_pruning_reaches_the_scan(spark, logs, tmp_path, capsys):
    from emberlog.sources.tables import between_closed
    path = str(tmp_path / "logs")
    tables.write_logs(month(logs), path)
    between_closed(tables.read_logs(spark, path), "2024-01-03 00:00:00", "2024-01-04 00:00:00").explain()
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[[^\n]*isnotnull\(log_date", plan) and "GreaterThanOrEqual(created_at" in plan


def test_expiry_splits_the_cutoff_day(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    rows = logs((1, "a", "x", "INFO", "2024-01-01 05:00:00"), (2, "a", "x", "INFO", "2024-01-10 11:59:59.999999"),
                (3, "a", "x", "INFO", "2024-01-10 12:00:00"), (4, "a", "x", "INFO", "2024-01-11 00:00:00"))
    tables.write_logs(rows, path)
    assert tables.expire_table(spark, path, "2024-01-20 12:00:00", 10) == 2
    assert ids(tables.read_logs(spark, path)) == [3, 4]
    assert [str(day) for day in tables.table_days(spark, path)] == ["2024-01-10", "2024-01-11"]
    assert tables.expire_table(spark, path, "2024-01-20 12:00:00", 10) == 0
    kept, gone = archive.expire_logs(rows, "2024-01-20 12:00:00", 10), rows.filter("created_at < '2024-01-10 12:00:00'")
    assert kept.count() + gone.count() == rows.count()


def test_compaction_keeps_the_rows(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    for load in range(3):
        tables.write_logs(logs((load, "a", "x", "INFO", "2024-01-01 05:00:00")), path, f"batch-{load}")
    tables.compact_day(spark, path, "2024-01-01", LOGS_SCHEMA)
    assert ids(tables.read_logs(spark, path)) == [0, 1, 2]
    left = [p.name for p in (tmp_path / "logs" / "log_date=2024-01-01").iterdir() if p.is_dir()]
    assert len(left) == 1 and left[0].startswith("load_id=base-")
    tables.write_logs(logs((1, "a", "x", "INFO", "2024-01-01 05:00:00")), path, "batch-1")  # a replay
    tables.write_logs(logs((7, "a", "x", "INFO", "2024-01-01 06:00:00")), path, "batch-7")  # a late load
    assert ids(tables.read_logs(spark, path)) == [0, 1, 2, 7]
    tables.compact_day(spark, path, "2024-01-01", LOGS_SCHEMA)
    assert ids(tables.read_logs(spark, path)) == [0, 1, 2, 7]


def test_a_crashed_rewrite_changes_nothing(spark, logs, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    for load in range(2):
        tables.write_logs(logs((load, "a", "x", "INFO", "2024-01-01 05:00:00")), path, f"batch-{load}")

    def crash(*args):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as patched:
        patched.setattr(tables, "on", lambda day, real=tables.on, seen=[]: crash() if len(seen) > 1 else seen.append(1) or real(day))
        with pytest.raises(RuntimeError):
            tables.compact_day(spark, path, "2024-01-01", LOGS_SCHEMA)
    assert ids(tables.read_logs(spark, path)) == [0, 1]
    tables.compact_day(spark, path, "2024-01-01", LOGS_SCHEMA)
    assert ids(tables.read_logs(spark, path)) == [0, 1]


def test_statistics_loads_are_summed_and_days_rebuilt(spark, logs, tmp_path):
    path = str(tmp_path / "stats")
    delta = rollup.hourly_rollup(month(logs))
    for load in ("a", "b", "b"):
        tables.write_statistics(delta, path, load)
    assert tables.read_statistics(spark, path).agg(F.sum("count")).first()[0] == 400
    tables.rebuild_statistics_day(month(logs), path, "2024-01-02")
    stats = tables.read_statistics(spark, path)
    assert rollup.reconcile_statistics(stats.filter("log_date = '2024-01-02'"),
                                       month(logs).filter("date(created_at) = '2024-01-02'")).filter("status != 'match'").count() == 0
    assert stats.agg(F.sum("count")).first()[0] == 390
    tables.compact_day(spark, path, "2024-01-03", STATISTICS_SCHEMA)
    assert tables.read_statistics(spark, path).agg(F.sum("count")).first()[0] == 390


def test_archive_runs_twice_without_repeats(spark, logs, tmp_path):
    root = str(tmp_path)
    tables.write_logs(month(logs), f"{root}/logs")
    assert run_archive(spark, root, "2024-01-21 00:00:00", 10) == 100
    assert run_archive(spark, root, "2024-01-21 00:00:00", 10) == 0
    assert run_archive(spark, root, "2024-01-22 00:00:00", 10) == 10
    tables.write_logs(logs((5000, "late", "x", "INFO", "2024-01-03 00:00:00")), f"{root}/logs", "late")
    assert unarchived_days(tables.read_logs(spark, f"{root}/logs").filter("log_date < '2024-01-12'"),
                           tables.read_archive(spark, f"{root}/archives")) == [date(2024, 1, 3)]
    assert run_archive(spark, root, "2024-01-22 00:00:00", 10) == 1
    stored = tables.read_archive(spark, f"{root}/archives").filter("id != 5000")
    assert stored.count() == stored.select("id").distinct().count() == 110
    long_ones = stored.filter("compressed").collect()
    assert all(r.original_size == 2000 and r.compressed_size == len(r.content) < 2000 for r in long_ones) and long_ones
    history = archive.log_history(tables.read_logs(spark, f"{root}/logs").filter("id != 5000"), stored)
    assert history.exceptAll(month(logs)).count() == 0 and history.count() == 200


def test_archive_keeps_compression_only_if_smaller(spark):
    import random
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(0x21, 0x7e)) for _ in range(1100))
    rows = spark.createDataFrame([(1, noise), (2, "ab" * 800), (3, "short"), (4, None), (5, "")], "id long, content string")
    found = {r.id: r for r in archive.archive_compress(archive.with_storage_columns(rows)).collect()}
    assert (found[1].compressed, found[1].compressed_size, found[1].content) == (False, 1100, noise)
    assert found[2].compressed and found[2].compressed_size < 1600
    assert (found[3].original_size, found[3].compressed_size) == (5, 5)
    assert (found[4].compressed, found[4].original_size, found[5].original_size) == (False, 0, 0)
    again = archive.archive_compress(archive.with_storage_columns(rows).withColumn("compressed", F.lit(True)).withColumn("original_size", F.lit(7)))
    assert {(r.compressed, r.original_size) for r in again.collect()} == {(True, 7)}


def test_nightly_jobs(spark, logs, tmp_path):
    root = str(tmp_path)
    tables.write_logs(month(logs), f"{root}/logs")
    tables.write_statistics(rollup.hourly_rollup(month(logs)), f"{root}/statistics", "live")
    assert run_nightly(spark, root, "2024-01-21 00:00:00", 5, 10) == {"archived": 150, "expired": 100}
    assert tables.read_logs(spark, f"{root}/logs").count() == 100
    assert tables.read_archive(spark, f"{root}/archives").count() == 150
    assert tables.read_statistics(spark, f"{root}/statistics").agg(F.sum("count")).first()[0] == 200


def test_prints_tell_drift_without_reading_logs(spark, logs, tmp_path, monkeypatch):
    root, days = str(tmp_path), [date(2024, 1, 1 + i) for i in range(20)]
    parts = [month(logs).filter(f"id % 3 = {k}") for k in range(3)]
    for k, part in enumerate(parts):
        tables.write_logs(part, f"{root}/logs", f"load-{k}")
        tables.write_statistics(rollup.hourly_rollup(part), f"{root}/statistics", f"load-{k}")
    assert prints.fill_prints(spark, f"{root}/logs", days) == 60
    assert prints.fill_prints(spark, f"{root}/logs", days) == 0
    assert prints.drifted_days(spark, root, days) == []
    assert prints.reconcile_stored(spark, root, days).count() == 0
    with monkeypatch.context() as patched:  # a night without drift: nothing is rebuilt
        patched.setattr("emberlog.plans.nightly.rebuild_statistics_day", None)
        run_nightly(spark, root, "2024-01-21 00:00:00", 50, 50)
    assert len(tables.day_loads(spark, f"{root}/statistics", "2024-01-20")) == 1
    assert prints.drifted_days(spark, root, days) == []
    # one more row; a load written anew under its name; a day of the rollup with another key
    tables.write_logs(logs((999, "s0", "x", "INFO", "2024-01-02 01:00:00")), f"{root}/logs", "late")
    tables.write_logs(logs((0, None, "x", "INFO", "2024-01-01 00:00:00")), f"{root}/logs", "load-0")
    tables.write_statistics(rollup.hourly_rollup(parts[1]).withColumn(
        "source", F.when(F.col("log_date") == "2024-01-05", "other").otherwise(F.col("source"))), f"{root}/statistics", "load-1")
    assert prints.drifted_days(spark, root, days) == [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 5)]
    found = prints.reconcile_stored(spark, root, days)
    assert {r.log_date.day for r in found.select("log_date").collect()} == {1, 2, 5}
    assert prints.drifted_days(spark, str(tmp_path / "none"), days) == []


def test_prints_do_not_read_bodies(spark, logs, tmp_path, monkeypatch):
    frames = type(logs((1, "a", "b", "INFO", "2024-01-01 00:00:00")))
    seen, real = [], frames.groupBy

    def noted(frame, *keys):
        grouped = real(frame, *keys)
        if "content" in frame.columns:
            seen.append(grouped.agg(F.sum(F.xxhash64("created_at", "source", "log_level").cast("decimal(28,0)")))
                        ._jdf.queryExecution().executedPlan().toString())
        return grouped

    tables.write_logs(month(logs), f"{tmp_path}/logs", "one")
    monkeypatch.setattr(frames, "groupBy", noted)
    prints.fill_prints(spark, f"{tmp_path}/logs", [date(2024, 1, 1)])
    assert seen and all("PartitionFilters: [" in plan and "content" not in plan.split("ReadSchema")[-1] for plan in seen)


def test_counted_write(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    assert tables.counted_write(month(logs), tables.write_logs, path) == 200
    assert tables.counted_write(month(logs).filter("id < 0"), tables.write_logs, path) == 0


def test_alerts_can_be_switched_off(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = spark.createDataFrame([(datetime(2024, 1, 1), "k", "ERROR", "s", "m")], tables.ALERT_SCHEMA)
    assert tables.write_alerts(alerts, path, enabled=False) is None and not tables.table_exists(spark, path)
    tables.write_alerts(alerts, path, "one")
    assert [r.message for r in tables.read_alerts(spark, path).collect()] == ["m"]


def test_csv_escapes_quotes_commas_and_lines(spark, logs, tmp_path):
    path = str(tmp_path / "csv")
    body = 'say "hi", then\nleave'
    messages.export_csv(logs((1, "a", body, "INFO", "2024-01-01 10:20:30.5")).coalesce(1), path)
    text = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_text()
    assert text.splitlines()[0] == '"ID","Timestamp","Source","Level","Content"'
    assert '"2024-01-01 10:20:30"' in text and '"say ""hi"", then' in text
    back = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).first()
    assert back.Content == body


def test_compression_report(spark):
    rows = spark.createDataFrame([("a", True, 1000, 250), ("a", False, 100, 100), ("b", False, 0, 0)],
                                 "source string, compressed boolean, original_size int, compressed_size int")
    overall = archive.compression_report(rows).first()
    assert tuple(overall) == (3, 1, 1100, 350, 68.18)
    assert {r.source: r.compression_rate for r in archive.compression_report(rows, "source").collect()} == {"a": 68.18, "b": 0.0}
    assert archive.compression_report(rows, "source", subtotals=True).count() == 3

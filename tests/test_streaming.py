import time
import random
from datetime import datetime, timedelta

import pytest
from models import burst_model, random_logs, repeat_model
from pyspark.sql import functions as F

from emberlog.operators import ingest, metrics, patterns, rollup
from emberlog.schemas import DETECTION_LOG
from emberlog.sinks import tables
from emberlog.sinks.index import read_index
from emberlog.sources.events import decode_events, read_event_stream
from emberlog.sources.files import lines_to_events
from emberlog.sources.tail import GrowingLogsReader, tail_log_files
from emberlog.streaming import consume, detectors, service

START = datetime(2024, 1, 1)
NOW = "2024-05-01 12:00:00"


def stream_of(spark, folder, *batches):
    """A stream that delivers each batch of log rows as one micro-batch, in order."""
    for number, rows in enumerate(batches):
        target = f"{folder}/part-{number}"
        spark.createDataFrame(rows, DETECTION_LOG).coalesce(1).write.parquet(target)
    return (spark.readStream.schema(DETECTION_LOG).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(str(folder)))


def drained(spark, stream, tmp_path, name="out"):
    out = str(tmp_path / name)
    consume.drain(stream, out, f"{out}-state")
    return spark.read.schema(stream.schema).parquet(out)


def in_thirds(rows):
    ordered = sorted(rows, key=lambda row: (row[4], row[0]))
    size = len(ordered) // 3
    return ordered[:size], ordered[size:2 * size], ordered[2 * size:]


def test_tail_sees_appended_finished_lines_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    app = folder / "app.log"
    app.write_bytes("one ERROR\ntwo 한글\nunfin".encode())
    (folder / "skip.txt").write_text("no\n")

    def run():
        lines = tail_log_files(spark, str(folder), split_bytes=7)
        return sorted((r.source, r.content) for r in drained(spark, lines, tmp_path).collect())

    assert run() == [("app.log", "one ERROR"), ("app.log", "two 한글")]
    with app.open("ab") as handle:
        handle.write(b"ished WARN\nthree\n")
    (folder / "late.log").write_bytes(b"first\r\n\n" + b"x" * 40 + b"\n")
    assert run() == [("app.log", "one ERROR"), ("app.log", "three"), ("app.log", "two 한글"),
                     ("app.log", "unfinished WARN"), ("late.log", ""), ("late.log", "first"), ("late.log", "x" * 40)]


def test_tail_reads_a_backlog_in_bounded_batches(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    sent = {}
    for name in ("a.log", "b.log", "c.log"):
        sent[name] = [f"{name} line {i} " + "x" * (i % 7) for i in range(40)]
        (folder / name).write_text("".join(line + "\n" for line in sent[name]))
    (folder / "d.log").write_text("y" * 500 + "\nend\n")  # a line longer than a batch
    sent["d.log"] = ["y" * 500, "end"]
    by_batch = {}

    def kept():
        return [row for number in sorted(by_batch) for row in by_batch[number]]

    def drain(until):
        def keep(batch, number):
            by_batch[number] = [(r.source, r.content) for r in batch.collect()]  # a batch that is run again counts once

        lines = tail_log_files(spark, str(folder), split_bytes=64, batch_bytes=200, progress=str(tmp_path / "p" / "at"))
        running = (lines.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state"))
                   .trigger(processingTime="0 seconds").start())
        for _ in range(600):
            if len(kept()) >= until or running.exception():
                break
            time.sleep(0.1)
        running.processAllAvailable() if until >= total else None
        running.stop()

    total = sum(map(len, sent.values()))
    drain(30)  # stopped in the middle, then gone on from the checkpoint
    drain(total)
    sizes = [sum(len(line) + 1 for _, line in rows) for rows in by_batch.values()]
    assert sorted(kept()) == sorted((name, line) for name, lines in sent.items() for line in lines)
    assert max(sizes) <= 501 and sorted(sizes)[-2] <= 200 and len(sizes) >= total * 12 // 200
    with (folder / "a.log").open("a") as handle:
        handle.write("more\n")
    total += 1
    drain(total)
    assert kept()[-1] == ("a.log", "more") and len(kept()) == total
    lost = GrowingLogsReader({"path": str(folder), "batchBytes": "200", "progress": str(tmp_path / "q" / "at")})
    behind = lost.latestOffset()
    with pytest.raises(RuntimeError, match="does not belong"):
        lost.partitions({str(folder / name): (folder / name).stat().st_size for name in sent}, behind)
    with pytest.raises(ValueError):
        GrowingLogsReader({"path": str(folder), "batchBytes": "5"})


def test_equal_lines_have_positions_and_times(spark, tmp_path):
    from emberlog.operators.ingest import with_event_id
    from emberlog.sources.files import lines_to_events
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "app.log").write_text("same ERROR\n" * 5)
    events = with_event_id(lines_to_events(tail_log_files(spark, str(folder), split_bytes=20, stamp=True)))
    rows = drained(spark, events, tmp_path).collect()
    assert len({r.id for r in rows}) == 5 and len({r.position for r in rows}) == 5
    assert len({r.timestamp for r in rows}) == 1 and rows[0].timestamp is not None


def test_tail_rereads_a_file_that_was_cut(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "app.log").write_text("a long first line\n")
    assert drained(spark, tail_log_files(spark, str(folder)), tmp_path).count() == 1
    (folder / "app.log").write_text("new\n")
    found = sorted(r.content for r in drained(spark, tail_log_files(spark, str(folder)), tmp_path).collect())
    assert found == ["a long first line", "new"]


@pytest.mark.parametrize("scope", ["source", None])
def test_streamed_bursts_equal_the_batch(spark, logs, tmp_path, scope):
    rows = random_logs(11)
    fired = detectors.stream_error_burst(stream_of(spark, tmp_path / "in", *in_thirds(rows)), "1 minute", 5, 20, 60, scope)
    found = sorted(r.id for r in drained(spark, fired, tmp_path).collect())
    assert found == burst_model(rows, 5, 20, 60, scope) and found


def test_streamed_repeats_equal_the_batch(spark, tmp_path):
    rows = random_logs(12)
    found = detectors.stream_repeated_error(stream_of(spark, tmp_path / "in", *in_thirds(rows)), "1 minute", 3, 40)
    expected = repeat_model(rows, 3, 40)
    assert {r.trigger_log.id: (r.additional_data.repeat_count, [x.id for x in r.related_logs])
            for r in drained(spark, found, tmp_path).collect()} == expected


def test_streamed_detections_have_the_batch_layout(spark, logs, tmp_path):
    rows = [(i, "a", "same text" if i else None, "ERROR", START + timedelta(seconds=i, microseconds=5)) for i in range(5)]
    batch = patterns.repeated_error(logs(*rows), 2, 60)
    stream = detectors.stream_repeated_error(stream_of(spark, tmp_path / "in", rows[:2], rows[2:]), "1 minute", 2, 60)
    assert drained(spark, stream, tmp_path).collect() == batch.collect()


def test_service_runs_all_streams(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    folder.mkdir()
    body = "connection to the payment service timed out"
    messages_in(spark, folder, 1, [message(2 * i, "ERROR", f"2024-01-01T10:00:{i:02d}", body) for i in range(12)])
    messages_in(spark, folder, 2, [message(1, "INFO", "2024-01-01T11:00:00")])
    started = service.start_service(read_event_stream(spark, str(folder)), root, NOW, "0 seconds", threshold=10, availableNow=True)
    for query in started.values():
        query.awaitTermination()
    alerts = {r.kind: r for r in tables.read_alerts(spark, f"{root}/alerts").collect()}
    assert set(alerts) == {"error-burst", "repeated-error"}
    assert alerts["error-burst"].message.endswith(f"s0 - {body} 18")
    assert alerts["repeated-error"].message.endswith(f"{body} 4")
    assert tables.read_logs(spark, f"{root}/logs").count() == 13
    assert [(r.processed, r.errors) for r in spark.read.parquet(f"{root}/minutes").collect()] == [(12, 12)]


def new_source_pattern():
    """A plug-in with state of its own: the first log of every source."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class FirstLog(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "logs bigint")

        def handleInputRows(self, key, rows, timerValues):
            rows = pd.concat(list(rows)).sort_values(["us", "id"])
            before = self.seen.get()[0] if self.seen.exists() else 0
            self.seen.update((before + len(rows),))
            yield rows.iloc[:0 if before else 1].assign(source=key[0])[["source", "id", "us"]]

        def close(self):
            pass

    class NewSource:
        pattern_id, name, description, severity, enabled = "new-source", "New source", "first log", "WARNING", True

        def detect_stream(self, logs, delay):
            found = logs.select("source", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us")).groupBy(
                "source").transformWithStateInPandas(FirstLog(), "source string, id bigint, us bigint", "Append", "None")
            return found.select(
                F.lit(self.pattern_id).alias("pattern_id"), F.lit(self.name).alias("pattern_name"),
                F.lit(True).alias("detected"), F.lit(self.severity).alias("severity"),
                F.concat(F.lit("new source "), "source").alias("message"),
                F.timestamp_micros("us").cast("timestamp_ntz").alias("detected_at"))

    return NewSource()


def test_plug_in_patterns_run_beside_the_detectors(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    folder.mkdir()
    broken, off = new_source_pattern(), new_source_pattern()
    broken.pattern_id, broken.detect_stream = "broken", lambda logs, delay: logs.select("no_such_column")
    off.pattern_id, off.enabled = "off", False
    failed = []

    def run():
        started = service.start_service(
            read_event_stream(spark, str(folder), max_per_trigger=1), root, lambda batch: datetime(2024, 5, 1, 12, batch),
            "0 seconds", threshold=10, patterns=[new_source_pattern(), broken, off],
            on_failure=lambda pattern, error: failed.append(pattern.pattern_id), availableNow=True)
        for query in started.values():
            query.awaitTermination()
        return set(started)

    messages_in(spark, folder, 1, [message(2 * i, "ERROR", f"2024-01-01T10:00:{i:02d}", "body") for i in range(12)])
    assert run() == {"store", "bursts", "repeats", "minutes", "pattern-new-source"} and failed == ["broken"]
    messages_in(spark, folder, 2, [message(k, "INFO", "2024-01-01T11:00:00") for k in range(4)])
    messages_in(spark, folder, 3, ['{"source":"late","content":"without a time"}'])
    run()  # what the first run saw is known from the state
    alerts = tables.read_alerts(spark, f"{root}/alerts").collect()
    assert sorted(r.message for r in alerts if r.kind == "new-source") == ["new source late", "new source s0", "new source s1"]
    assert {r.kind for r in alerts} >= {"error-burst", "new-source"}
    # The function tells the store the time of the batch: an event without one is not put at one constant for ever.
    late = tables.read_logs(spark, f"{root}/logs").filter("source = 'late'").first()
    assert late.created_at in {datetime(2024, 5, 1, 12, 1), datetime(2024, 5, 1, 12, 2)}


def test_pattern_ids_must_differ(spark, tmp_path):
    logs = stream_of(spark, tmp_path / "in", [(1, "a", "x", "ERROR", START)])
    with pytest.raises(ValueError, match="must differ"):
        service.start_patterns(logs, str(tmp_path / "root"), [new_source_pattern(), new_source_pattern()])


def test_state_expires_without_changing_results(spark, tmp_path):
    batches = [[(10 * n + i, "a", "same", "ERROR", START + timedelta(hours=n, seconds=i)) for i in range(3)] for n in range(4)]
    rows = [row for batch in batches for row in batch]
    fired = detectors.stream_error_burst(stream_of(spark, tmp_path / "in", *batches), "0 seconds", 3, 60, 300)
    assert sorted(r.id for r in drained(spark, fired, tmp_path).collect()) == burst_model(rows, 3, 60, 300, "source") == [2, 12, 22, 32]


def test_streamed_rollup_and_minutes_equal_the_batch(spark, logs, tmp_path):
    rows = random_logs(13, seconds=4 * 3600)
    sentinel = [(10_000, "z", "end", "INFO", START + timedelta(days=1))]
    stream = stream_of(spark, tmp_path / "in", *in_thirds(rows), sentinel)
    hours = drained(spark, rollup.streaming_rollup(stream, "1 minute"), tmp_path, "hours")
    assert sorted(map(tuple, hours.collect())) == sorted(map(tuple, rollup.hourly_rollup(logs(*rows)).collect()))
    stream = spark.readStream.schema(DETECTION_LOG).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    minutes = drained(spark, metrics.streaming_minute_metrics(stream, "0 seconds"), tmp_path, "minutes")
    assert sorted(map(tuple, minutes.collect())) == sorted(map(tuple, metrics.minute_metrics(logs(*rows)).collect()))


def test_late_rows_do_not_enter_closed_hours(spark, tmp_path):
    first = [(1, "a", "x", "INFO", START), (2, "a", "x", "INFO", START + timedelta(hours=3))]
    late = [(3, "a", "x", "INFO", START), (4, "a", "x", "INFO", START + timedelta(hours=9))]
    # Spark drops late rows by the watermark of the batch before, so one batch lies in between.
    between = [(5, "a", "x", "INFO", START + timedelta(hours=4))]
    stream = stream_of(spark, tmp_path / "in", first, between, late)
    found = sorted((r.hour, r["count"]) for r in drained(spark, rollup.streaming_rollup(stream, "0 seconds"), tmp_path).collect())
    assert found == [(0, 1), (3, 1), (4, 1)]


def test_streamed_windows(spark, logs, tmp_path):
    rows = [(i, "a", "x", "ERROR", START + timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 70, 600))]
    found = patterns.windowed_burst(stream_of(spark, tmp_path / "in", rows), "1 minute", 3, watermark="0 seconds")
    assert [(r.window_start, r.errors) for r in drained(spark, found, tmp_path).collect()] == [(START, 3)]


def messages_in(spark, folder, number, values):
    (folder / f"{number}.txt").write_text("\n".join(values) + "\n")


def message(i, level="INFO", at="2024-01-01T10:00:00", body="body"):
    return f'{{"source":"s{i % 2}","content":"{body} {i}","logLevel":"{level}","timestamp":"{at}"}}'


def test_consumer_stores_every_message_once(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()

    def run():
        stream = read_event_stream(spark, str(folder), max_per_trigger=1)
        consume.consume_events(stream, root, f"{root}-state", NOW, with_index=True, availableNow=True).awaitTermination()

    messages_in(spark, folder, 1, [message(i) for i in range(20)] + ["broken {"])
    run()
    run()
    messages_in(spark, folder, 2, [message(i, "ERROR") for i in range(20, 30)])
    run()
    assert tables.read_logs(spark, f"{root}/logs").count() == 30
    stats = tables.read_statistics(spark, f"{root}/statistics")
    assert stats.agg(F.sum("count")).first()[0] == 30 and stats.filter("log_level = 'ERROR'").agg(F.sum("count")).first()[0] == 10
    assert [r.raw for r in spark.read.parquet(f"{root}/rejects").collect()] == ["broken {"]
    index = read_index(spark, f"{root}/index")
    assert index.documents.count() == 30 and index.terms.filter("term = 'body'").count() == 30
    assert index.grams.filter("gram = 'ody'").select("term").distinct().count() == 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    batch = spark.createDataFrame([(message(i),) for i in range(12)], "value string")
    for _ in range(2):
        consume.consume_batch(batch, root, "batch-7", NOW)
    assert tables.read_logs(spark, f"{root}/logs").count() == 12
    assert tables.read_statistics(spark, f"{root}/statistics").agg(F.sum("count")).first()[0] == 12


def test_dedup_and_ingest_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    messages_in(spark, folder, 1, [message(1, "ERROR"), message(1, "ERROR"), message(2, "DEBUG"), message(3, "WARN")])
    events = decode_events(read_event_stream(spark, str(folder)))
    ready = ingest.ingest_events(ingest.dedup_events(ingest.with_event_id(events), delay="1 hour"), NOW)
    assert sorted(r.content for r in drained(spark, ready, tmp_path).collect()) == ["body 1", "body 3"]


def test_alerts_of_a_stream_reach_the_sink(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = [(i, "a", "same", "ERROR", START + timedelta(seconds=i)) for i in range(5)]
    stream = stream_of(spark, tmp_path / "in", rows)
    alerts = patterns.burst_alerts(stream.filter("id = 4"), 5, 60)
    for _ in range(2):
        consume.emit_alerts(alerts, lambda batch, load: tables.write_alerts(batch, path, load),
                            f"{path}-state", availableNow=True).awaitTermination()
    assert tables.read_alerts(spark, path).count() == 1


def test_lines_of_files_enter_the_same_steps(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("x ERROR y\nplain\n")
    events = ingest.ingest_events(lines_to_events(tail_log_files(spark, str(folder))), NOW)
    found = sorted((r.content, r.route, str(r.timestamp)) for r in drained(spark, events, tmp_path).collect())
    assert found == [("plain", "INFO", "2024-05-01 12:00:00"), ("x ERROR y", "ERROR", "2024-05-01 12:00:00")]


@pytest.mark.parametrize("seed", [1, 2])
def test_held_detectors_equal_the_batch_in_any_order(spark, logs, tmp_path, seed):
    rows = random_logs(seed + 40)
    rng = random.Random(seed)
    files = [[], [], []]
    times = sorted(r[4] for r in rows)
    cuts = [times[len(times) // 3], times[2 * len(times) // 3]]
    for row in rows:  # a row may come a file early or late, by up to a minute
        moved = row[4] + timedelta(seconds=rng.randint(-60, 60))
        files[sum(moved >= cut for cut in cuts)].append(row)
    stream = stream_of(spark, tmp_path / "in", *files, [(10**6, "zz", "end", "ERROR", times[-1] + timedelta(days=1))])
    fired = detectors.stream_error_burst(stream, "10 minutes", 5, 20, 60, hold=True)
    found = sorted(r.id for r in drained(spark, fired, tmp_path / "a").collect())
    assert found == burst_model(rows, 5, 20, 60, "source") and found
    repeats = detectors.stream_repeated_error(stream, "10 minutes", 3, 20, hold=True)
    mine = sorted((r.trigger_log.id, r.additional_data.repeat_count) for r in drained(spark, repeats, tmp_path / "b").collect())
    batch = patterns.repeated_error(logs(*rows), 3, 20).collect()
    assert mine == sorted((r.trigger_log.id, r.additional_data.repeat_count) for r in batch) and mine


def kept_rows(held, tmp_path):
    """Rows that each stateful operator of a stream keeps in the end."""
    query = (held.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return {op["operatorName"]: op["numRowsTotal"] for op in query.lastProgress["stateOperators"]}


def waiting_errors():
    """Errors of one source and message, a second apart, one of them twice."""
    rows = [(i, "a", "same", "ERROR", START + timedelta(seconds=i)) for i in range(50)]
    return [*rows, rows[7]]


def test_waiting_burst_errors_are_kept_apart(spark, tmp_path):
    """Errors that wait are rows of their own in all partitions, not entries of their key in the detector."""
    fired = detectors.stream_error_burst(stream_of(spark, tmp_path / "in", waiting_errors()), "10 days", hold=True)
    assert kept_rows(fired, tmp_path) == {"stateStoreSave": 50, "transformWithStateInPandasExec": 0}


def test_waiting_repeated_errors_are_kept_apart(spark, tmp_path):
    found = detectors.stream_repeated_error(stream_of(spark, tmp_path / "in", waiting_errors()), "10 days", hold=True)
    assert kept_rows(found, tmp_path) == {"stateStoreSave": 50, "transformWithStateInPandasExec": 0}


class FakeState:
    """States of one key in memory, with the bytes that are written."""

    def __init__(self):
        self.value, self.entries, self.written = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def keys(self):
        return iter(list(self.entries))

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value
        self.written += len(value[0])

    def removeKey(self, key):
        del self.entries[key]


class FakeHandle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, FakeState())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, FakeState())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def listTimers(self):
        return iter(list(self.timers))


class FakeClock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_held_errors_are_written_once():
    """A batch writes what it brings, whatever waits; slices are taken in order and nothing stays behind."""
    import pandas as pd
    processor, handle = detectors.BurstProcessor(3, 10_000_000, 60_000_000, hold=True), FakeHandle()
    processor.init(handle)
    rng = random.Random(4)
    times = [rng.randrange(300_000_000) for _ in range(3000)]
    written = []
    for at in range(0, 3000, 100):
        batch = pd.DataFrame([("s", k, "a", "x", "ERROR", times[k]) for k in range(at, at + 100)],
                             columns=processor.waiting_columns)
        before = handle.states["waiting"].written
        assert list(processor.handleInputRows(("s",), iter([batch[:40], batch[40:]]), None)) == []
        written.append(handle.states["waiting"].written - before)
    assert max(written) < 1.3 * min(written)
    fired = []
    for ms in sorted(handle.timers):
        for found in processor.handleExpiredTimer(("s",), FakeClock(ms), None):
            fired += found["us"].tolist()
    while handle.timers - {0}:
        ms = min(handle.timers)
        handle.timers.discard(ms)
        assert not list(processor.handleExpiredTimer(("s",), FakeClock(ms), None))
    whole = detectors.BurstProcessor(3, 10_000_000, 60_000_000)
    whole.init(FakeHandle())
    errors = pd.DataFrame([("s", k, "a", "x", "ERROR", us) for k, us in enumerate(times)], columns=processor.waiting_columns)
    expected = [us for found in whole.handleInputRows(("s",), iter([errors]), None) for us in found["us"]]
    assert fired == expected and len(fired) > 3
    assert not handle.states["waiting"].entries and not handle.states["marks"].exists()

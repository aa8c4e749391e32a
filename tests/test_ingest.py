from datetime import datetime

from emberlog.operators import ingest
from emberlog.schemas import EVENT_SCHEMA
from emberlog.sinks.messages import publish_events
from emberlog.sources.events import decode_events, decode_rejects, requests_to_events
from emberlog.sources.files import lines_to_events, read_log_files

NOW = "2024-05-01 12:00:00"
T = datetime(2024, 1, 1, 10)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)


def test_defaults_fill_only_what_is_missing(spark):
    rows = events(spark, ("s", "c", "ERROR", T), ("s", "c", "ERROR", None), ("s", "c", None, T),
                  ("s", "c", "  ", T), (None, "c", "warn", T), ("  ", None, "x", T))
    found = [tuple(r) for r in ingest.normalize_events(rows.coalesce(1), NOW).collect()]
    assert found == [("s", "c", "ERROR", T), ("s", "c", "ERROR", datetime(2024, 5, 1, 12)), ("s", "c", "INFO", T),
                     ("s", "c", "INFO", T), ("unknown", "c", "warn", T), ("unknown", None, "x", T)]


def test_filter_rules(spark):
    rows = events(spark, ("a", "1", "ERROR", T), ("a", "2", "debug", T), ("a", "3", "odd", T), ("a", "4", None, T),
                  ("skip", "5", "ERROR", T), (" skip", "6", "ERROR", T), ("performance-test", "7", "DEBUG", T),
                  (None, "8", "WARN", T))

    def kept(**options):
        return sorted(r.content for r in ingest.filter_events(rows, **options).collect())

    assert kept() == ["1", "5", "6", "7", "8"]
    assert kept(excluded_sources="skip,other") == ["1", "6", "7", "8"]
    assert kept(excluded_sources="other, skip") == ["1", "5", "7", "8"]
    assert kept(min_level="debug") == ["1", "2", "5", "6", "7", "8"]
    assert kept(min_level="nonsense") == list("12345678")
    assert kept(min_level="ERROR", excluded_sources="performance-test") == ["1", "5", "6", "7"]


def test_routes_and_split(spark):
    rows = events(spark, ("a", "1", "error", T), ("a", "2", "odd", T), ("a", "3", None, T), ("a", "4", "DEBUG", T))
    split = {name: sorted(r.content for r in part.collect()) for name, part in ingest.route_split(rows).items()}
    assert split == {"ERROR": ["1"], "WARN": [], "INFO": ["2", "3"], "DEBUG": ["4"]}


def test_ids_are_equal_on_a_retry(spark):
    rows = events(spark, ("a", "1", "error", T), ("a", "2", "odd", None))
    first, second = (sorted(r.correlation_id for r in ingest.enrich_events(rows, now).collect())
                     for now in (NOW, "2030-01-01 00:00:00"))
    assert first == second and len(set(first)) == 2


def test_decoding_tolerates_unknown_fields_and_rejects_the_rest(spark):
    values = ['{"source":"a","content":"x","logLevel":"INFO","timestamp":"2024-01-01T10:00:00","extra":1}',
              '{"source":"a","content":"no time"}', '{"source":"a","content":', 'plain', '',
              '{"source":"a","content":"x","timestamp":"2024-01-01T10:00:00.123456"}']
    messages = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
    good = [tuple(r) for r in decode_events(messages).collect()]
    assert good == [("a", "x", "INFO", T), ("a", "no time", None, None),
                    ("a", "x", None, datetime(2024, 1, 1, 10, 0, 0, 123456))]
    assert decode_rejects(messages).count() == 3


def test_messages_carry_the_source_as_key(spark):
    rows = events(spark, ("svc", 'say "hi"\n', "INFO", T))
    sent = publish_events(rows).first()
    assert sent.key == "svc" and '"logLevel":"INFO"' in sent.value and "2024-01-01T10:00:00" in sent.value
    assert [tuple(r) for r in decode_events(publish_events(rows)).collect()] == [("svc", 'say "hi"\n', "INFO", T)]


def test_requests_in_any_shape(spark):
    requests = spark.createDataFrame([("INFO", "x", 1)], "logLevel string, content string, other int")
    assert tuple(requests_to_events(requests).first()) == (None, "x", "INFO", None)


def test_files(spark, tmp_path):
    (tmp_path / "app.log").write_text("2024 [t] ERROR 한글\nplain\n", encoding="utf-8")
    (tmp_path / "other.txt").write_text("ERROR no\n")
    rows = lines_to_events(read_log_files(spark, str(tmp_path))).collect()
    assert sorted(tuple(r)[:3] for r in rows) == [("app.log", "2024 [t] ERROR 한글", "ERROR"), ("app.log", "plain", "INFO")]


def test_log_rows_have_sizes(spark):
    long_body = "log " * 600
    rows = ingest.with_event_id(events(spark, ("a", long_body, "INFO", None), ("a", None, "INFO", T), ("a", "é", None, T)))
    found = {r.original_size: r for r in ingest.to_log_rows(rows, NOW).collect()}
    assert found[2400].compressed and found[2400].compressed_size == len(found[2400].content) < 2400
    assert (found[0].compressed, found[0].compressed_size, found[2].compressed_size) == (False, 0, 2)
    assert str(found[2400].log_date) == "2024-05-01"


def test_dedup_of_a_batch(spark):
    rows = ingest.with_event_id(events(spark, *[("a", "same", "INFO", T)] * 50, ("a", "else", "INFO", T)))
    assert ingest.dedup_events(rows).count() == 2

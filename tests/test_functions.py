import base64
import gzip

import pytest
from pyspark.sql import functions as F

from emberlog.functions import compression, levels, measures, text, times


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def evaluate(spark, values, expression, kind="string"):
    return [row[0] for row in column(spark, values, kind).coalesce(1).select(expression(F.col("v"))).collect()]


def test_level_rules(spark):
    assert evaluate(spark, ["ERROR", "warn", "Info", "DEBUG", "trace", "", None], levels.level_rank) == [4, 3, 2, 1, 0, 0, 0]
    lines = ["x WARN y ERROR", "error", "a DEBUG", "WARNING", "plain", "DEBUG WARN"]
    assert evaluate(spark, lines, levels.derive_level) == ["ERROR", "INFO", "DEBUG", "WARN", "INFO", "WARN"]
    assert evaluate(spark, ["error", "trace", None], levels.known_level) == ["ERROR", "INFO", "INFO"]
    assert evaluate(spark, ["INFO", "WARNING", "ERROR", "CRITICAL"], levels.severity_rank) == [0, 1, 2, 3]


@pytest.mark.parametrize("rate,response,status", [
    (15.0, 500, "WARNING"), (15.01, 0, "DEGRADED"), (0.0, 501, "DEGRADED"),
    (5.0, 200, "UP"), (5.01, 0, "WARNING"), (0.0, 201, "WARNING")])
def test_status_limits_are_strict(spark, rate, response, status):
    assert spark.range(1).select(levels.system_status(F.lit(rate), F.lit(response))).first()[0] == status


def test_sizes_count_utf16_units_and_bytes(spark):
    assert evaluate(spark, ["a😀", "é", None], measures.original_size) == [5, 2, 0]
    assert evaluate(spark, ["a😀", "é", "abc"], compression.utf16_length) == [3, 1, 3]


def test_compression_needs_more_than_the_minimum(spark):
    values = ["x" * 1024, "x" * 1025, "😀" * 512, "😀" * 512 + "x", "é" * 1024, None, ""]
    assert evaluate(spark, values, compression.should_compress) == [False, True, False, True, False, False, False]
    assert evaluate(spark, ["x" * 5000], lambda c: compression.should_compress(c, enabled=False)) == [False]


def test_only_base64_of_gzip_counts_as_compressed(spark):
    packed = base64.b64encode(gzip.compress(b"hello")).decode()
    bare = packed.rstrip("=")
    other = base64.b64encode(b"plain text").decode()
    values = [packed, bare, other, packed + "!", packed + "\n", "H4s", "H4sI", "H4sIA", "H4sI=", "H4w=", "", None, "no"]
    assert evaluate(spark, values, compression.is_compressed) == [
        True, True, False, False, False, True, True, False, False, False, False, False, False]


def test_round_trip_and_unreadable_bodies(spark):
    broken = base64.b64encode(gzip.compress(b"hello")[:-6]).decode()
    values = ["repeat " * 400, "한글 로그 " * 300, "short", broken, "H4sI", None]
    packed = evaluate(spark, values, lambda c: compression.compress(c, compression.should_compress(c)))
    assert packed[0] != values[0] and len(packed[0]) < len(values[0]) / 2 and packed[2:] == values[2:]
    assert evaluate(spark, packed, compression.decompress) == values
    # Compressing compressed text changes nothing.
    assert evaluate(spark, packed[:2], lambda c: compression.compress(c, compression.should_compress(c))) == packed[:2]


def test_multiline_text_is_never_taken_for_gzip(spark):
    assert evaluate(spark, ["H4sIAAAA\nH4sIAAAA"], compression.is_compressed) == [False]


def test_tokens_and_ngrams(spark):
    assert evaluate(spark, ["Disk-full: /var/LOG 97%", "", None], text.tokens) == [
        ["disk", "full", "var", "log", "97"], [], []]
    assert evaluate(spark, ["from 192.168.0.1: can't open user_id=a.b.c 1,000;5 a.1 x:y _ __a 3. 4"], text.tokens) == [
        ["from", "192.168.0.1", "can't", "open", "user_id", "a.b.c", "1,000;5", "a", "1", "x:y", "__a", "3", "4"]]
    assert evaluate(spark, ["로그 기록 日本 カタ ひ"], text.tokens) == [["로그", "기록", "日", "本", "カタ", "ひ"]]
    assert evaluate(spark, ["x" * 600 + " y"], text.tokens) == [["x" * 255, "x" * 255, "x" * 90, "y"]]
    grams = evaluate(spark, ["abc a abc"], lambda c: text.ngrams(text.tokens(c)))[0]
    assert sorted(grams) == ["ab", "abc", "bc"]
    assert text.query_terms(spark, "Disk-full disk") == ["disk", "full"]
    assert text.query_terms(spark, "abc", grams=True) == ["ab", "abc", "bc"]


def test_error_rate_rounds_half_up_and_handles_zero(spark):
    rows = spark.createDataFrame([(0, 0), (1, 3), (1, 800), (5, 5)], "e long, t long")
    assert [r[0] for r in rows.select(measures.error_rate(F.col("e"), F.col("t"))).collect()] == [0.0, 33.33, 0.13, 100.0]


def test_times_do_not_depend_on_the_session_zone(spark):
    stamp = F.lit("2024-03-10 02:30:00.123456").cast("timestamp_ntz")
    expected = 1710037800123456
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.range(1).select(
                times.micros(stamp).alias("us"), (times.from_micros(times.micros(stamp)) == stamp).alias("same"),
                (times.wall_time(times.instant(stamp)) == stamp).alias("wall")).first()
            assert (row.us, row.same, row.wall) == (expected, True, True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_presets():
    start, end = times.preset_bounds("2024-01-31 00:00:00", "7d")
    assert (end - start).days == 7
    assert times.preset_bounds("2024-01-31 00:00:00", "odd") == times.preset_bounds("2024-01-31 00:00:00")


def test_a_batch_of_bodies_is_not_held_as_texts():
    import tracemalloc

    import pyarrow as pa
    from emberlog.functions import compression
    bodies = pa.array([f"{i:07d} " * 2000 for i in range(1500)] + [None, ""])
    packed = compression._pack_all.func(bodies)
    tracemalloc.start()
    assert compression._unpack_all.func(packed).equals(bodies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < bodies.nbytes / 4
    assert len(compression._unpack_all.func(pa.array([], pa.string()))) == 0

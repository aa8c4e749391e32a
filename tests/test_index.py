"""The stored index: pruning, merged segments, damage, expiry."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlog.operators import search
from emberlog.plans import searching
from emberlog.plans.nightly import run_nightly
from emberlog.plans.searching import search_store
from emberlog.schemas import LOGS_SCHEMA
from emberlog.sinks import index, tables


def ids(frame):
    return sorted(int(r.id) for r in frame.select("id").collect())


def some_logs(logs, first, days=3, words="disk"):
    return logs(*[(first + d, "a", f"{words} number {first + d}", "INFO", datetime(2024, 1, 1 + d, 10)) for d in range(days)])


def test_a_search_reads_the_days_and_loads_that_have_hits(spark, logs, tmp_path, monkeypatch):
    path = str(tmp_path)
    index.index_logs(some_logs(logs, 0), path, "one")
    index.index_logs(some_logs(logs, 10, words="fan"), path, "two")
    index.index_logs(logs((20, "a", "fan rare", "INFO", "2024-01-02 11:00:00")), path, "three")
    assert ids(search.search_index(index.read_index(spark, path), keyword="rare")) == [20]
    with monkeypatch.context() as patched:
        patched.setattr(search, "LISTED_PARTITIONS", 0)
        found = search.search_index(index.read_index(spark, path), keyword="rare")
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "content" in line]
        assert len(scans) == 1 and "dynamicpruning" in scans[0], scans
        assert ids(found) == [20]
    assert ids(search.search_index(index.read_index(spark, path), keyword="fan", start="2024-01-02 00:00:00",
                                   end="2024-01-02 23:59:59")) == [11, 20]
    for file in (tmp_path / "documents").rglob("*.parquet"):  # unreadable, yet of equal length
        if "log_date=2024-01-02/load_id=three" not in str(file):
            file.write_bytes(bytes(file.stat().st_size))
    spark.catalog.refreshByPath(path)
    assert ids(search.search_index(index.read_index(spark, path), keyword="rare")) == [20]


def test_vocabulary_grows_with_new_words_only(spark, logs, tmp_path):
    path = str(tmp_path)
    index.index_logs(logs((1, "a", "disk full", "INFO", "2024-01-01 10:00:00")), path, "one", buckets=5)
    grams = spark.read.parquet(f"{path}/grams").count()
    index.index_logs(logs((2, "a", "full disk", "INFO", "2024-01-02 10:00:00")), path, "two", buckets=99)
    assert spark.read.parquet(f"{path}/grams").count() == grams
    assert index.table_buckets(spark, path) == 5
    assert ids(search.search_index(index.read_index(spark, path), keyword="ful", mode="ngram_any")) == [1, 2]


def test_segments_are_merged_in_levels(spark, logs, tmp_path):
    path = str(tmp_path)
    for load in range(5):
        index.index_logs(logs((load, "a", f"disk w{load}", "INFO", f"2024-01-0{1 + load % 2} 10:00:00")), path,
                         f"load-{load}", buckets=2, fanout=2)
    for kind in ("terms", "words", "grams"):
        levels = [row.level for row in index.live_segments(spark, path) if row.kind == kind]
        assert sorted(levels) == [0, 2]
        folders = {p.name for p in (tmp_path / kind).glob("bucket=*/segment=*")}
        assert len(folders) <= 2
    stored = index.read_index(spark, path)
    assert ids(search.search_index(stored, keyword="disk")) == list(range(5))
    assert ids(search.search_index(stored, keyword="w2 w4")) == [2, 4]
    assert ids(search.search_index(stored, keyword="w", mode="ngram_any")) == []
    assert ids(search.search_index(stored, keyword="w4", mode="ngram_any")) == [4]
    index.index_logs(logs((0, "a", "disk w0", "INFO", "2024-01-01 10:00:00")), path, "load-0")  # a replay of a merged load
    assert ids(search.search_index(index.read_index(spark, path), keyword="disk")) == list(range(5))
    index.rewrite_day(spark, path, datetime(2024, 1, 1).date())
    assert index.index_days(spark, path) == {datetime(2024, 1, 1).date(): 1, datetime(2024, 1, 2).date(): 2}
    assert ids(search.search_index(index.read_index(spark, path), keyword="w2 w3")) == [2, 3]


@pytest.mark.parametrize("kind", ["terms", "documents", "grams"])
def test_a_cut_file_changes_no_result(spark, logs, tmp_path, kind):
    root = str(tmp_path)
    for load in range(2):
        rows = some_logs(logs, 10 * load)
        tables.write_logs(rows, f"{root}/logs", f"load-{load}")
        index.index_logs(rows, f"{root}/index", f"load-{load}", fanout=2)
    whole = ids(search_store(spark, root, keyword="disk"))
    part = ids(search_store(spark, root, keyword="isk", mode="ngram_any"))
    assert whole == part == [0, 1, 2, 10, 11, 12]
    for file in sorted((tmp_path / "index" / kind).rglob("*.parquet"))[:2]:
        file.write_bytes(file.read_bytes()[:-9])
    assert ids(search_store(spark, root, keyword="disk")) == whole
    assert ids(search_store(spark, root, keyword="isk", mode="ngram_any")) == part
    if kind != "grams":
        assert len(index.indexed_loads(spark, f"{root}/index").collect()) < 2


def test_damaged_loads_are_written_again(spark, logs, tmp_path):
    path = str(tmp_path)
    index.index_logs(some_logs(logs, 0), path, "one")
    next((tmp_path / "documents").rglob("*.parquet")).unlink()
    assert index.indexed_loads(spark, path).collect() == []
    index.index_logs(some_logs(logs, 0), path, "one")
    assert [r.load_id for r in index.indexed_loads(spark, path).collect()] == ["one"]
    assert ids(search.search_index(index.read_index(spark, path), keyword="disk")) == [0, 1, 2]


def test_expired_logs_are_not_found_and_stay_away(spark, logs, tmp_path):
    root = str(tmp_path)
    rows = logs(*[(k, "a", f"disk {k}", "INFO", datetime(2024, 1, 1 + k // 4, 6 * (k % 4), 0, 0, 500_000)) for k in range(16)])
    for load in range(2):
        part = rows.filter(F.col("id") % 2 == load)
        tables.write_logs(part, f"{root}/logs", f"load-{load}")
        index.index_logs(part, f"{root}/index", f"load-{load}")
    bare = rows.filter("id = 15").withColumn("id", F.lit(99).cast("long"))
    tables.write_logs(bare, f"{root}/logs", "bare")
    assert run_nightly(spark, root, "2024-01-13 12:00:00.4", 100, 10) == {"archived": 0, "expired": 10}
    left = [*range(10, 16), 99]
    for _ in range(2):
        assert sorted(r.id for r in tables.read_logs(spark, f"{root}/logs").collect()) == left
        assert ids(search_store(spark, root, keyword="disk")) == left
        assert ids(search_store(spark, root, engine="index", keyword="disk")) == left[:-1]
        for load in range(2):  # replays of expired loads change nothing
            part = rows.filter(F.col("id") % 2 == load)
            tables.write_logs(part, f"{root}/logs", f"load-{load}")
            index.index_logs(part, f"{root}/index", f"load-{load}")


def test_expiry_without_logs_goes_by_the_second(spark, logs, tmp_path):
    path = str(tmp_path)
    index.index_logs(some_logs(logs, 0), path, "one")
    index.expire_index(spark, path, "2024-01-12 10:00:01", 10)
    assert ids(search.search_index(index.read_index(spark, path), keyword="disk")) == [2]
    assert list(index.index_days(spark, path)) == [datetime(2024, 1, 2).date(), datetime(2024, 1, 3).date()]


def dealt_by(spark, frame):
    """The plan of ``frame`` with no broadcast by size: what is dealt out by which columns."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frame.filter("true")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    return [line for line in plan.splitlines() if "hashpartitioning(" in line] if joins else []


def test_logs_of_one_load_do_not_meet_in_one_task(spark, logs, tmp_path):
    rows = some_logs(logs, 0)
    tables.write_logs(rows, f"{tmp_path}/logs", "one")
    stored = tables.read_load_logs(spark, f"{tmp_path}/logs")
    loads = spark.createDataFrame([("one",)], "load_id string")
    rest = searching._not_indexed(stored, loads, search.index_documents(rows))
    assert not any("hashpartitioning(load_id" in line for line in dealt_by(spark, rest)) and not rest.count()


def test_postings_are_not_read_for_stored_ngrams(spark, logs, tmp_path, monkeypatch):
    path = str(tmp_path)
    index.index_logs(some_logs(logs, 0), path, "one")
    grams = index.read_index(spark, path).grams
    assert grams.inputFiles() and all("/grams/" in file for file in grams.inputFiles())
    index.index_logs(some_logs(logs, 10, words="fan"), path, "two", with_ngrams=False)
    for most in (search.BROADCAST_WORDS, 1):
        monkeypatch.setattr(search, "BROADCAST_WORDS", most)
        both = index.read_index(spark, path)
        assert ids(search.search_index(both, keyword="dis", mode="ngram_any")) == [0, 1, 2]
        assert ids(search.search_index(both, keyword="umb", mode="ngram_any")) == [0, 1, 2, 10, 11, 12]


def test_documents_of_a_load_do_not_meet_in_one_task(spark, logs, tmp_path):
    path = str(tmp_path)
    index.index_logs(some_logs(logs, 0), path, "one", with_ngrams=False)
    found = index.read_index(spark, path).documents.select("id", "content")
    assert not any("hashpartitioning(load" in line and "log_date" in line for line in dealt_by(spark, found))
    assert ids(found) == [0, 1, 2]


def test_postings_of_a_day_do_not_meet_in_one_merge_task(spark, logs, tmp_path, monkeypatch):
    path, merged, write = str(tmp_path), [], index._write_segment
    for load in ("one", "two"):
        index.index_logs(some_logs(logs, 0), path, load, with_ngrams=False)

    def recorded(rows, *args, **more):
        merged.append(dealt_by(spark, rows))
        write(rows, *args, **more)

    monkeypatch.setattr(index, "_write_segment", recorded)
    index.merge_segments(spark, path, fanout=2)
    assert merged == [[]]


def test_logs_of_a_day_do_not_meet_in_one_task(spark, logs, tmp_path):
    path = f"{tmp_path}/logs"
    tables.write_logs(some_logs(logs, 0), path, "one")
    tables.write_logs(some_logs(logs, 10), path, "two")
    tables.compact_day(spark, path, "2024-01-01", LOGS_SCHEMA)
    stored = tables.read_load_logs(spark, path).select("id", "content", "log_date", "load_id")
    assert not dealt_by(spark, stored)
    assert ids(stored) == [0, 1, 2, 10, 11, 12]


def test_what_all_rows_share_is_not_shuffled(spark, logs, tmp_path, monkeypatch):
    frame, dealt = type(logs()), []
    monkeypatch.setattr(frame, "hint", lambda self, *a, f=frame.hint: dealt.append(self.columns) or f(self, *a))
    index.index_logs(some_logs(logs, 0), str(tmp_path), "one")
    segments = [columns for columns in dealt if "bucket" in columns]
    assert len(segments) == 3 and not any({"load", "segment"} & set(columns) for columns in segments)
    assert {row.load for row in index.read_index(spark, str(tmp_path)).terms.collect()} == {"one"}

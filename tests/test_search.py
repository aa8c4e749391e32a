import pytest
from pyspark.sql import functions as F

from emberlog.operators import search
from emberlog.plans.searching import search_store
from emberlog.schemas import LOGS_SCHEMA
from emberlog.sinks import index as stored_index
from emberlog.sinks import tables
from emberlog.sources.tables import count_all, find_by_id


@pytest.fixture
def some(logs):
    return logs((1, "test-service", "Disk 100% full", "INFO", "2024-01-01 10:00:00"),
                (2, "test-service", "disk 100 full_", "WARN", "2024-01-01 11:00:00"),
                (3, "api-service", "Login failed: *user*", "ERROR", "2024-01-01 12:00:00.7"))


def ids(frame):
    return sorted(int(r.id) for r in frame.select("id").collect())


def test_criteria_are_literal_and_anded(some):
    assert ids(search.search_logs(some)) == [1, 2, 3]
    assert ids(search.search_logs(some, keyword="DISK")) == [1, 2]
    assert ids(search.search_logs(some, keyword="API")) == [3]
    assert ids(search.search_logs(some, content="100%")) == [1]
    assert ids(search.search_logs(some, content="full_")) == [2]
    assert ids(search.search_logs(some, content="*")) == [3]
    assert ids(search.search_logs(some, source="TEST", level="WARN")) == [2]
    assert ids(search.search_logs(some, level="warn")) == []


def test_range_needs_both_ends(some):
    assert ids(search.search_logs(some, start="2024-01-01 11:30:00")) == [1, 2, 3]
    assert ids(search.search_logs(some, start="2024-01-01 11:00:00", end="2024-01-01 12:00:00")) == [2]


def test_index_search(spark, some, tmp_path):
    stored_index.index_logs(some, str(tmp_path), "one")
    stored_index.index_logs(some, str(tmp_path), "one")
    index = stored_index.read_index(spark, str(tmp_path))
    assert index.documents.count() == 3
    assert index.terms.exceptAll(index.terms.distinct()).count() == 0

    def found(**criteria):
        stored = ids(search.search_index(index, **criteria))
        assert stored == ids(search.search_index(search.build_index(some), **criteria))
        return stored

    assert found() == [1, 2, 3]
    assert found(keyword="full login") == [1, 3]      # "full_" is a word of its own
    assert found(keyword="full_") == [2]
    assert found(keyword="ful") == []
    assert found(keyword="ful", mode="ngram_any") == [1, 2]
    assert found(keyword="user", level=" ERROR ", source="api") == [3]
    assert found(source="API") == []
    assert found(keyword="  ", level="") == [1, 2, 3]
    assert found(content="100%") == [1]
    assert found(start="2024-01-01 11:00:00.9", end="2024-01-01 12:00:00.1") == [2, 3]
    with pytest.raises(ValueError):
        found(keyword="x", mode="odd")


def test_engines(spark, some, tmp_path):
    stored_index.index_logs(some, str(tmp_path), with_ngrams=False)
    index = stored_index.read_index(spark, str(tmp_path))
    by_index = search.search(some, index, keyword="disk")
    by_table = search.search(some, index, engine="table", keyword="disk", mode="token_any")
    assert by_index.columns == by_table.columns and ids(by_index) == ids(by_table) == ids(search.search(some, keyword="disk"))
    with pytest.raises(ValueError):
        search.search(some, engine="index", keyword="x")


def test_pages(some, logs):
    assert [r.id for r in search.page(some, 0, 2, "created_at", "DESC").collect()] == [3, 2]
    assert [r.id for r in search.page(some, 1, 2, "created_at", "desc").collect()] == [1]
    assert search.page(some, 5, 2).collect() == []
    assert [r.id for r in search.page(some, 0, 5, "log_level", "anything").collect()] == [3, 1, 2]
    assert tuple(search.page_totals(some, 2).first()) == (3, 2)
    with pytest.raises(ValueError):
        search.page(some, sort_by="1; drop")


def test_paging_after_a_row_sees_every_row_once(logs):
    rows = logs(*[(i, f"s{i % 3}", "x", "INFO", f"2024-01-01 00:00:{i % 7:02d}") for i in range(40)])
    for direction in ("asc", "desc"):
        seen, after = [], None
        while True:
            batch = search.page(rows, size=7, sort_by="created_at", direction=direction, after=after).collect()
            if not batch:
                break
            seen += [r.id for r in batch]
            after = (batch[-1].created_at, batch[-1].id)
        expected = [r.id for r in search.page(rows, size=40, sort_by="created_at", direction=direction).collect()]
        assert seen == expected


def test_lookups(some):
    assert find_by_id(some, 2).first().log_level == "WARN" and count_all(some).first().total == 3
    documents = search.index_documents(some)
    assert ids(search.find_by_content(documents, "DISK")) == [1, 2]
    assert ids(search.find_by_level(documents, "ERROR")) == [3]
    assert ids(search.find_by_source(documents, "api")) == [3]
    assert ids(search.find_by_time(documents, "2024-01-01 12:00:00", "2024-01-01 12:00:00")) == [3]
    assert documents.filter(F.col("id") == "3").first().timestamp.microsecond == 0


def test_loads_without_index_are_found(spark, logs, tmp_path):
    root = str(tmp_path)
    parts = {load: logs((k, "a", f"disk {load}", "INFO", "2024-01-01 10:00:00"), (k + 10, "a", "disks", "INFO", "2024-01-02 10:00:00"))
             for k, load in enumerate(("one", "two", "three"))}
    for load, rows in parts.items():
        tables.write_logs(rows, f"{root}/logs", load)
    assert ids(search_store(spark, root, keyword="disk")) == [0, 1, 2, 10, 11, 12]  # no index: a text in the logs
    stored_index.index_logs(parts["one"], f"{root}/index", "one")
    stored_index.index_logs(parts["two"], f"{root}/index", "two")
    assert ids(search_store(spark, root, keyword="disk")) == [0, 1, 2]
    assert ids(search_store(spark, root, engine="index", keyword="disk")) == [0, 1]
    assert ids(search_store(spark, root, keyword="three two")) == [1, 2]
    tables.compact_day(spark, f"{root}/logs", "2024-01-01", LOGS_SCHEMA)  # rows of indexed and other loads in one
    assert ids(search_store(spark, root, keyword="disk")) == [0, 1, 2]
    documents = spark.read.parquet(f"{root}/index/documents").filter("load_id = 'two'")
    half = documents.withColumns({"load_id": F.lit("half"), "load": F.lit("half")})  # a load that stopped before its terms were written
    half.write.mode("append").partitionBy("log_date", "load_id").parquet(f"{root}/index/documents")
    assert ids(search_store(spark, root)) == [0, 1, 2, 10, 11, 12]

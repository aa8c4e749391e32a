"""Search over the log table and over an inverted index of it."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import contains_ci, ngrams, query_terms, tokens
from emberlog.functions.times import at, parse, to_second
from emberlog.schemas import PAGE_SIZE
from emberlog.sources.tables import between_closed, between_dates

TERM_BUCKETS = 16
#: Partitions with hits that a search names in its plan; with more, their days prune at run time.
LISTED_PARTITIONS = 500
#: Words with a wanted n-gram that go to all tasks; with more, postings are shuffled to them.
BROADCAST_WORDS = 500_000


def given(value: str | None) -> str | None:
    """A search parameter, or nothing where it is blank."""
    return value.strip() if value and value.strip() else None


def search_logs(logs: DataFrame, keyword: str | None = None, level: str | None = None,
                source: str | None = None, content: str | None = None,
                start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Table search. Criteria are ANDed; texts are literal, case-insensitive substrings; the range
    counts only with both ends. Pass readable bodies: see ``readable``."""
    found = logs
    if start is not None and end is not None:
        found = between_closed(found, start, end)
    if level is not None:
        found = found.filter(F.col("log_level") == level)
    if source is not None:
        found = found.filter(contains_ci(F.col("source"), source))
    if content is not None:
        found = found.filter(contains_ci(F.col("content"), content))
    if keyword is not None:
        found = found.filter(contains_ci(F.col("content"), keyword) | contains_ci(F.col("source"), keyword))
    return found


def index_documents(logs: DataFrame) -> DataFrame:
    """One search document per log: string id, time in whole seconds."""
    columns = [F.col("id").cast("string").alias("id"), F.col("source"), F.col("content"),
               F.col("log_level"), to_second(F.col("created_at")).alias("timestamp")]
    if "log_date" in logs.columns:
        columns.append(F.col("log_date"))
    return logs.select(*columns)


class SearchIndex(NamedTuple):
    """Documents, postings (term, id) of their words, and the n-grams (gram, term) of the words.

    N-grams belong to the vocabulary, not to the documents: the same matches from an index that
    grows with new words instead of with all text. A stored index knows the day and load of each posting,
    and ``places`` (load, log_date, load_id) in which partition these documents lie now.
    """

    documents: DataFrame
    terms: DataFrame
    grams: DataFrame
    places: DataFrame | None = None
    buckets: int = TERM_BUCKETS


def index_terms(documents: DataFrame) -> DataFrame:
    """Postings (term, id) of search documents, each once. Terms are made distinct inside their
    document, so no shuffle is needed."""
    return documents.select("id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))


def index_grams(terms: DataFrame) -> DataFrame:
    """The n-grams (gram, term) of all words that occur in postings."""
    words = terms.select("term").distinct()
    return words.select("term", F.explode(ngrams(F.array("term"))).alias("gram"))


def build_index(logs: DataFrame) -> SearchIndex:
    """An index that is not stored."""
    documents = index_documents(logs)
    terms = index_terms(documents)
    return SearchIndex(documents, terms, index_grams(terms))


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _with_value(rows: DataFrame, column: str, wanted: list[str], buckets: int) -> DataFrame:
    """Rows of the wanted terms or grams; stored ones are pruned to their buckets."""
    found = rows.filter(F.col(column).isin(*wanted))
    if "bucket" in rows.columns:
        found = found.filter(F.col("bucket").isin(*[term_bucket(F.lit(value), buckets) for value in wanted]))
    return found


def matching_ids(index: SearchIndex, keyword: str, mode: str = "token_any") -> DataFrame:
    """Ids of documents that share a term with ``keyword``, and their day and load where the index is stored.

    ``token_any``: a whole word. ``ngram_any``: any n-gram, as an n-gram analyzed query matches.
    """
    if mode not in ("token_any", "ngram_any"):
        raise ValueError(f"unknown search mode {mode!r}")
    spark = index.terms.sparkSession
    columns = ["id"] if index.places is None else ["id", "log_date", "load"]
    found = _with_value(index.terms, "term", query_terms(spark, keyword), index.buckets).select(*columns)
    if mode == "ngram_any":
        words = _with_value(index.grams, "gram", query_terms(spark, keyword, grams=True), index.buckets)
        words = words.select("term").distinct()
        if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
            words = F.broadcast(words)
        found = found.unionByName(index.terms.join(words, "term", "left_semi").select(*columns))
    return found


def _matching_documents(documents: DataFrame, index: SearchIndex, hits: DataFrame) -> DataFrame:
    """Documents of the hits. In a stored index only days and loads that have hits are read: where there are few, by
    name, else by the days, which prune while the search runs; these are at most as many as the folders that the
    driver lists, so they may be broadcast."""
    if index.places is None:
        return documents.join(hits, "id", "left_semi")
    partitions = hits.select("log_date", "load").distinct().join(index.places, ["log_date", "load"]).select(
        "log_date", "load_id").distinct()
    named = partitions.limit(LISTED_PARTITIONS + 1).collect()
    if len(named) <= LISTED_PARTITIONS:
        for column in ("log_date", "load_id"):
            documents = documents.filter(F.col(column).isin(*{row[column] for row in named}))
    else:
        documents = documents.join(F.broadcast(partitions.select("log_date").distinct()), "log_date", "left_semi")
    return documents.join(hits.select("id", "log_date"), ["id", "log_date"], "left_semi")


def search_index(index: SearchIndex, keyword: str | None = None, level: str | None = None,
                 source: str | None = None, content: str | None = None,
                 start: datetime | str | None = None, end: datetime | str | None = None,
                 mode: str = "token_any") -> DataFrame:
    """Index search. The source is a case-sensitive substring, the range has whole seconds and
    includes both ends, blank criteria are ignored."""
    keyword, level, source, content = (given(v) for v in (keyword, level, source, content))
    found, hits = index.documents, None
    if keyword:
        hits = matching_ids(index, keyword, mode)
    if level:
        found = found.filter(F.col("log_level") == level)
    if source:
        found = found.filter(F.col("source").contains(source))
    if content:
        found = found.filter(contains_ci(F.col("content"), content))
    if start is not None and end is not None:
        low, high = parse(start).replace(microsecond=0), parse(end).replace(microsecond=0)
        found = between_dates(found, low.date(), high.date())
        found = found.filter(F.col("timestamp").between(at(low), at(high)))
        hits = hits and between_dates(hits, low.date(), high.date())
    if hits is not None:
        found = _matching_documents(found, index, hits)
    return found.drop("load_id")


def search(logs: DataFrame, index: SearchIndex | None = None, engine: str = "auto",
           **criteria) -> DataFrame:
    """Search through the index where there is one, else through the table; one result layout."""
    if engine == "index" and index is None:
        raise ValueError("no index to search")
    if index is not None and engine != "table":
        found = search_index(index, **criteria)
    else:
        criteria.pop("mode", None)
        found = index_documents(search_logs(logs, **criteria))
    return found.select("id", "source", "content", "log_level", "timestamp")


def page(rows: DataFrame, number: int = 0, size: int = PAGE_SIZE, sort_by: str = "created_at",
         direction: str = "desc", after: tuple | None = None, tie: str = "id") -> DataFrame:
    """One page of sorted rows. ``after`` = (sort value, id) of the last row seen continues from
    there without sorting the pages before; use it for deep pages."""
    if sort_by not in rows.columns:
        raise ValueError(f"cannot sort by {sort_by!r}")
    descending = direction.lower() == "desc"
    if after is not None:
        rows = rows.filter(_beyond(sort_by, tie, after, descending, rows))
        number = 0

    def ordered(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    keys = [ordered(sort_by)] + ([ordered(tie)] if tie != sort_by else [])
    return rows.orderBy(*keys).offset(number * size).limit(size)


def _beyond(sort_by: str, tie: str, after: tuple, descending: bool, rows: DataFrame) -> Column:
    """Rows after ``after`` in the order of ``page``: nulls come last descending, and first ascending."""
    def place(name: str, seen) -> tuple[Column, Column]:
        column = F.col(name)
        if seen is None:
            return (F.lit(False) if descending else column.isNotNull()), column.isNull()
        value = F.lit(str(seen)).cast(rows.schema[name].dataType)
        beyond = column.isNull() | (column < value) if descending else column > value
        return F.coalesce(beyond, F.lit(False)), column.eqNullSafe(value)

    later, same = place(sort_by, after[0])
    return later if tie == sort_by else later | (same & place(tie, after[1])[0])


def page_totals(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Number of rows and of pages of ``size``."""
    return rows.agg(F.count("*").alias("total_elements")).withColumn(
        "total_pages", F.ceil(F.col("total_elements") / F.lit(size)).cast("long"))


def find_by_level(documents: DataFrame, level: str) -> DataFrame:
    return documents.filter(F.col("log_level") == level)


def find_by_source(documents: DataFrame, part: str) -> DataFrame:
    return documents.filter(F.col("source").contains(part))


def find_by_content(documents: DataFrame, part: str) -> DataFrame:
    return documents.filter(contains_ci(F.col("content"), part))


def find_by_time(documents: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    return documents.filter(F.col("timestamp").between(at(parse(start).replace(microsecond=0)),
                                                       at(parse(end).replace(microsecond=0))))

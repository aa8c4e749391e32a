"""What the operators share: inputs with clean names, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlog.session import scratch_path, ship_package

#: Rows of an Arrow batch that goes back to Spark: batches stay small whatever the input's rows weigh.
ROWS_OUT = 512
#: Spark's setting that an execution removes its shuffle files as it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string): other columns, whatever their names, can't clash later."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage and survives lost executors.
    Once it is written, nothing needs the shuffles that made it, so their files go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed inside frees its shuffle files as it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def arrow_map(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` over row tuples: ``make()`` is called once a task and gives a function from the
    batches' columns (as lists) to rows (tuples in the order of ``schema``)."""
    ship_package(df.sparkSession)
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        work = make()
        forget_unasked()
        rows: list[tuple] = []
        for row in work(batches):
            rows.append(row)
            if len(rows) >= ROWS_OUT:
                yield pack(rows, arrow)
                rows = []
        if rows:
            yield pack(rows, arrow)
        rows = []
        release_memory()

    return df.mapInArrow(run, kinds)


_loaded: dict[tuple, object] = {}
_asked: set[tuple] = set()


def once(kind, *args):
    """One ``kind(*args)`` a worker process, for tasks in a row that ask for it."""
    key = (kind, *args)
    _asked.add(key)
    if key not in _loaded:
        _loaded[key] = kind(*args)
    return _loaded[key]


def forget_unasked() -> None:
    """Drop what this worker holds by :func:`once` for tasks before and this task, set up by now, hasn't asked for:
    workers are reused, and a stage's tables would stay beside those of all stages after it."""
    unasked = _loaded.keys() - _asked
    _asked.clear()
    if unasked:
        for key in unasked:
            del _loaded[key]
        release_memory()


def release_memory() -> None:
    """Hand freed memory back to the machine; Spark reuses workers, and idle ones would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, step).columns), strict=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

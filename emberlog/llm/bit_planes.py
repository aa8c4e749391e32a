"""Token-ID output as shuffled planes.

Documents go out in ascending id order as one stream of token ids. The stream of a part (one task) is cut into
blocks of a fixed number of ids; a block is transposed into byte or bit planes, each plane is compressed with
zstandard, and a chunk row stores the planes together with the index of the documents in it. Chunks are rows of a
Parquet table, so Spark commits, retries and reads them on any file system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_words import KEPT_WORDS, ByteWords, Kept
from .common import arrow_map, keyed_text, once, rows_of

BLOCK_IDS = 65_536
CHUNKS = """part int, chunk int, n_ids int, continued boolean, open boolean, ordinals array<long>,
            doc_ids array<long>, lengths array<int>, layout string, planes array<binary>"""
PIECES = """part int, ordinal long, doc_id long, chunk int, first_id long, n int, whole boolean, ids binary"""


class WordIds:
    """The ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, kept_words: int = KEPT_WORDS):
        self.bpe, self.kept_words = ByteWords(name), kept_words
        self.table = Kept(lambda word: np.array(
            [piece.id for piece in self.bpe.pieces(self.bpe.shown(word))], "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        out = []
        for place, segment in enumerate(self.bpe.segments(text)):
            if place % 2:
                out.append(np.array([self.bpe.specials[segment]], "<u4").tobytes())
            elif segment:
                out.append(b"".join(map(self.table.__getitem__, self.bpe.words(segment))))
        self.table.trim(self.kept_words)
        return b"".join(out)


def to_planes(ids: bytes, layout: str) -> list[bytes]:
    """``ids`` (little-endian unsigned 32-bit) as compressed planes: 4 of bytes or 32 of bits."""
    table = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    if layout == "bit":
        table = np.unpackbits(table, axis=1, bitorder="little")
    packer = zstandard.ZstdCompressor(level=3)
    planes = np.ascontiguousarray(table.T)
    return [packer.compress((np.packbits(p, bitorder="little") if layout == "bit" else p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, layout: str) -> bytes:
    """The reverse of :func:`to_planes`."""
    unpacker = zstandard.ZstdDecompressor()
    size = (n_ids + 7) // 8 if layout == "bit" else n_ids
    raw = [np.frombuffer(unpacker.decompress(p, max_output_size=size), np.uint8) for p in planes]
    if layout == "bit":
        bits = np.stack([np.unpackbits(p, count=n_ids, bitorder="little") for p in raw], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").tobytes()
    return np.stack(raw, axis=1).tobytes()


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
                 block_ids: int = BLOCK_IDS, layout: str = "byte", id_col: str = "doc_id", text_col: str = "text",
                 kept_words: int = KEPT_WORDS) -> None:
    """Encode every whole text, append ``end_id`` and write the chunks to ``path`` in ascending ``id_col`` order.
    ``kept_words`` bounds the words that a worker remembers; results don't depend on it.

    A null text counts as empty. Null ids come first; rows with equal ids are ordered by their text. Both split
    freely over parts, so one id may hold any share of the rows. An empty table writes an empty table.
    """
    if layout not in ("byte", "bit"):
        raise ValueError(f"layout is byte or bit, not {layout}")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = keyed_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        from pyspark import TaskContext

        coder, part = once(WordIds, tokenizer, kept_words), TaskContext.get().partitionId()

        def run(batches) -> Iterator[tuple]:
            chunk, held, size, continued = 0, [], 0, False
            index: list[tuple[int, int | None, int]] = []

            def emit(still_open: bool) -> tuple:
                ordinals, ids, lengths = map(list, zip(*index, strict=True))
                planes = to_planes(b"".join(held), layout)
                return part, chunk, size, continued, still_open, ordinals, ids, lengths, layout, planes

            for ordinal, (doc_id, text) in enumerate(rows_of(batches, 64)):
                ids = coder.encode(text or "") + end
                at, total = 0, len(ids) // 4
                while at < total:
                    n = min(total - at, block_ids - size)
                    held.append(ids[4 * at:4 * (at + n)])
                    index.append((ordinal, doc_id, n))
                    at, size = at + n, size + n
                    if size == block_ids:
                        yield emit(at < total)
                        chunk, held, size, continued, index = chunk + 1, [], 0, at < total, []
            if size:
                yield emit(False)

        return run

    arrow_map(ordered, make, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document of a written table; ``ids`` are little-endian 32-bit integers.

    A document inside one chunk comes straight from it; only those cut by a block's end are put together again.
    The ids of all others are never shuffled: where a part begins, one number a part, goes to every task.
    """
    chunks = spark.read.parquet(path)
    block = chunks.agg(F.max("n_ids")).first()[0] or 0

    def make():
        def run(batches) -> Iterator[tuple]:
            for (part, chunk, n_ids, continued, still_open, ordinals, doc_ids, lengths, layout,
                 planes) in rows_of(batches, 1):
                ids, at, last = from_planes(planes, n_ids, layout), 0, len(lengths) - 1
                for k, (ordinal, doc_id, n) in enumerate(zip(ordinals, doc_ids, lengths, strict=True)):
                    whole = not (k == 0 and continued) and not (k == last and still_open)
                    yield part, ordinal, doc_id, chunk, chunk * block + at, n, whole, ids[4 * at:4 * (at + n)]
                    at += n

        return run

    pieces = arrow_map(chunks, make, PIECES)
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = totals.select("part", F.coalesce(F.sum("n_part").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    cut = (pieces.filter("NOT whole").groupBy("part", "ordinal")
           .agg(F.first("doc_id").alias("doc_id"), F.min("first_id").alias("first_id"),
                F.sum("n").cast("int").alias("n"),
                F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("cuts"))
           .withColumn("ids", F.expr("aggregate(cuts, X'', (all, c) -> concat(all, c.ids))")))
    columns = ["part", "doc_id", "first_id", "n", "ids"]
    whole = pieces.filter("whole").select(*columns).union(cut.select(*columns))
    return whole.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("first_id")).alias("start"), F.col("n").cast("long").alias("n_tokens"), "ids")

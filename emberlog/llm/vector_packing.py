"""Packing documents into token sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). An item of some
length demands a vector of all three, so items of one length are alike, and so are open sequences with one residual.
``plan_packing`` therefore runs best fit decreasing over lengths instead of documents: each step puts as many items of a
length as the rule would into as many like sequences as there are. Its input is the number of items of each length,
its output a short table of runs, both bounded by the longest sequence, whatever the documents.

The documents never meet: a task encodes its own and numbers their pieces by length, counts of the tasks give each
piece its number among all of its length, and the plan's runs turn that into a sequence and a place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import scratch_path, ship_package

from .bit_planes import WordIds
from .common import arrow_map, keyed_text, once, rows_of

PIECES = "part int, doc_id long, piece int, start long, length int, nth long, ids binary"
#: Bits of a number among the items of one length; lengths and numbers make one sortable key of 63 bits.
NUMBER_BITS = 42


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most. ``documents`` and ``attention`` of None do not bind."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        if not 0 < self.tokens < 2 ** (63 - NUMBER_BITS):
            raise ValueError(f"a sequence of {self.tokens} tokens can't be planned")
        whole = (self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2)
        if min(whole) < 1 or whole[2] < self.longest() ** 2:
            raise ValueError("no document fits an empty sequence")
        return np.array(whole, np.int64)

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return self.tokens if self.attention is None else min(self.tokens, int(self.attention ** 0.5))


class Run(NamedTuple):
    """Items ``first`` to ``first + sequences * each - 1`` of a length: ``each`` go into every sequence from
    ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    each: int
    sequences: int
    sequence: int
    offset: int


#: How much tokens, documents and attention count when sequences are compared.
WEIGHTS = (1.0, 0.01, 0.01)


def plan_packing(counts: dict[int, int], capacities: Capacities = Capacities(), rule: str = "norm",
                 weights: tuple[float, float, float] = WEIGHTS) -> list[Run]:
    """Vector best fit, longest items first.

    Of the sequences that an item fits in every capacity, it goes to the one with the least ``norm`` (weighted squared
    length of what is left after it) or the least ``dot`` (weighted product of its demand with what is left before it);
    ties go to the sequence opened first. Where it fits none, a new one opens. All are measured by their capacity.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is norm or dot, not {rule}")
    whole, scale = capacities.vector(), np.array(weights)
    left = np.zeros((0, 3), np.int64)  # a row a group of like sequences
    first = np.zeros(0, np.int64)
    many = np.zeros(0, np.int64)
    runs: list[Run] = []
    opened = 0

    def score(rows: np.ndarray, demand: np.ndarray) -> np.ndarray:
        if rule == "norm":
            return (((rows - demand) / whole) ** 2 * scale).sum(axis=-1)
        return (rows / whole * (demand / whole) * scale).sum(axis=-1)

    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        todo, at = counts[length], 0
        if todo and (demand > whole).any():
            raise ValueError(f"an item of {length} tokens fits no sequence")
        while todo:
            fits = np.flatnonzero((left >= demand).all(axis=1))
            if len(fits):
                best = fits[np.lexsort((first[fits], score(left[fits], demand)))[0]]
                before, there = left[best], int(many[best])
            else:
                best, before, there = -1, whole, todo
            each, after = 1, before - demand
            mark = score(before, demand)
            while each < todo and (after >= demand).all() and (best < 0 or score(after, demand) <= mark):
                each, after = each + 1, after - demand
            # Where a fuller sequence ranks behind a new turn, it waits as a group of its own.
            sequences = max(min(there, todo // each), 1)
            start = opened if best < 0 else int(first[best])
            runs.append(Run(length, at, each, sequences, start, int(whole[0] - before[0])))
            at, todo = at + each * sequences, todo - each * sequences
            if best < 0:
                opened += sequences
            else:
                first[best] += sequences
                many[best] -= sequences
            left, first, many = (np.concatenate(x) for x in (
                (left, [after]), (first, [start]), (many, [sequences])))
            open_ones = (many > 0) & (left > 0).all(axis=1)
            left, first, many = left[open_ones], first[open_ones], many[open_ones]
    return runs


def token_pieces(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
                 longest: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, cut those over ``longest`` and write the pieces to ``path``.

    Of a cut document only the first piece is shorter. ``nth`` numbers the pieces of one length within their part.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make():
        from pyspark import TaskContext

        coder, part = once(WordIds, tokenizer), TaskContext.get().partitionId()
        seen = [0] * (longest + 1)

        def run(batches) -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, 64):
                ids = coder.encode(text or "") + end
                total = len(ids) // 4
                at, size = 0, (total - 1) % longest + 1
                for piece in range((total - 1) // longest + 1):
                    yield part, doc_id, piece, at, size, seen[size], ids[4 * at:4 * (at + size)]
                    seen[size] += 1
                    at, size = at + size, longest

        return run

    spark = docs.sparkSession
    arrow_map(keyed_text(docs, id_col, text_col), make, PIECES).write.parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def place_pieces(pieces: DataFrame, capacities: Capacities = Capacities(), rule: str = "norm",
                 weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``pieces`` (with part, length and nth) without ``nth``, with ``sequence_id`` and ``offset``.

    One length may have any share of the rows: pieces are numbered where they are, and only counts by part and length
    are summed up. Leave out ``ids`` where they aren't needed: columns travel with the pieces.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {row.length: row.n for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(n >> NUMBER_BITS for n in counts.values()):
        raise ValueError(f"over 2 ** {NUMBER_BITS} pieces of one length")
    runs = np.array(sorted(plan_packing(counts, capacities, rule, weights)), np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << NUMBER_BITS) + runs[:, 1]
    ship_package(pieces.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("length", "nth"))
            run = runs[np.searchsorted(keys, (length << NUMBER_BITS) + nth, side="right") - 1]
            turn, seat = np.divmod(nth - run[:, 1], run[:, 2])
            columns = [batch.column(name) for name in batch.schema.names if name != "nth"]
            columns += [pa.array(run[:, 4] + turn), pa.array(run[:, 5] + seat * length)]
            yield pa.RecordBatch.from_arrays(columns, names=placed.fieldNames())

    numbered = pieces.join(before, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    placed = numbered.drop("nth").withColumns({name: F.lit(0).cast("long") for name in ("sequence_id", "offset")}).schema
    return numbered.mapInArrow(place, placed)


def pack_documents(docs: DataFrame, capacities: Capacities = Capacities(), tokenizer: str = "byte_bpe_50k.json",
                   end_id: int = 2, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(length, doc_id, piece, start, ids, sequence_id, offset) for every piece of every row.

    ``ids`` are little-endian 32-bit integers. Null texts count as empty: they are one ``end_id``. Rows with equal or
    null ids are packed each; other columns are ignored; an empty table gives an empty one. A document of more tokens
    than fit a sequence is cut into pieces of that size, the first one shorter.
    """
    pieces = token_pieces(docs, scratch_path(docs.sparkSession, "pieces"), tokenizer, end_id, capacities.longest(),
                          id_col, text_col)
    return place_pieces(pieces, capacities, rule, weights)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths, doc_ids): the packed sequences themselves; each holds a bounded number of pieces."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(
        F.struct("offset", "length", "doc_id", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.expr("aggregate(rows, X'', (all, r) -> concat(all, r.ids))").alias("ids"),
                       F.col("rows.length").alias("lengths"), F.col("rows.doc_id").alias("doc_ids"))

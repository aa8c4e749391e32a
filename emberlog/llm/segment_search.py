"""Exact top-k inner products by multi-resolution segment statistics.

A vector is summarised at several resolutions: cut into 1, 2, 4, ... segments, each kept as its mean and deviation.
Within a segment of length L, Cauchy and Schwarz bound the product of two vectors by
``L * (mean * mean + deviation * deviation)``; in terms of distance, that is the lower bound
``sum L * ((mean - mean)^2 + (deviation - deviation)^2)``. Bounds tighten from coarse to fine. A pair is dropped as
soon as a bound lies below the query's k-th best score so far, and only survivors are computed exactly.

Where most pairs survive a scan, the exact products of all pairs of two blocks cost less than bounds and gathered rows:
then the next few blocks are multiplied whole, and the bounds are tried again after them. Results are the same.

Vectors are packed into blocks with their statistics (the index, a table). Query blocks are put in groups of bounded
size, and every group meets every lane of index blocks: a task holds the queries of one group, lets the blocks of one
lane pass once, and keeps k rows per query, which a last step merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, rows_of, shuffle_partitions, written

BLOCK_ROWS = 2_048
#: Queries of a group, about: a task holds one group at once.
QUERIES_HELD = 200_000
#: Scores and components are longs.
LARGEST = 2.0**63
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Share of pairs from which on gathered products cost more than the matrix product, and blocks until the next try.
LOOSE_SHARE, LOOSE_BLOCKS = 0.125, 15
BLOCKS = "lane int, dim int, n int, largest double, ids binary, components binary, statistics binary"
HITS = "query_id long, vec_id long, score long"


def levels_of(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: powers of two up to a quarter of the components, each dividing ``dim``."""
    levels = [1]
    while dim and dim % (2 * levels[-1]) == 0 and 2 * levels[-1] <= max(1, dim // 4):
        levels.append(2 * levels[-1])
    return levels


def segment_statistics(vectors: np.ndarray) -> np.ndarray:
    """Per vector and level, the means and deviations of its segments, times the root of the segments' length."""
    n, dim = vectors.shape
    if not dim:
        return np.zeros((n, 2))
    parts = []
    for segments in levels_of(dim):
        cut = vectors.reshape(n, segments, dim // segments)
        root = np.sqrt(dim // segments)
        parts += [cut.mean(axis=2) * root, cut.std(axis=2) * root]
    return np.concatenate(parts, axis=1)


def pack_blocks(vectors: DataFrame, lanes: int, id_col: str, vector_col: str, block_rows: int) -> DataFrame:
    """Rows of up to ``block_rows`` vectors of one length, as integers ``floor(1024 * x)``, with statistics."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                            F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id IS NOT NULL")

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def run(batches) -> Iterator[tuple]:
            held: dict[int, list] = {}
            made = 0

            def emit(dim: int) -> tuple:
                ids = np.concatenate([i for i, _ in held[dim]])
                ints = np.concatenate([v for _, v in held[dim]])
                largest = float(np.abs(ints).max()) if ints.size else 0.0
                statistics = segment_statistics(ints.astype(np.float64))
                return ((part * 31 + made) % lanes, dim, len(ids), largest, ids.astype("<i8").tobytes(),
                        ints.astype("<i8").tobytes(), statistics.astype("<f8").tobytes())

            for ids, matrix in _matrices(batches, block_rows):
                dim = matrix.shape[1]
                held.setdefault(dim, []).append((ids, matrix))
                if sum(len(i) for i, _ in held[dim]) >= block_rows:
                    yield emit(dim)
                    made, held[dim] = made + 1, []
            for dim in [d for d, rows in held.items() if rows]:
                yield emit(dim)
                made += 1

        return run

    return arrow_map(source, make, BLOCKS)


def _matrices(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix) of the usable vectors of one length, from each slice of each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            ids, lists = piece.column(0).to_numpy(zero_copy_only=False), piece.column(1)
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            given = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                flat = np.floor(1024.0 * given)
            ends = np.cumsum(np.maximum(lengths, 0))
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                matrix = flat[(ends[rows] - dim)[:, None] + np.arange(dim)[None, :]]
                fine = np.isfinite(given[(ends[rows] - dim)[:, None] + np.arange(dim)[None, :]]).all(axis=1)
                if (np.abs(matrix[fine]) >= LARGEST).any():
                    raise OverflowError("a component times 1024 does not fit a long")
                if fine.any():
                    yield ids[rows[fine]].astype(np.int64), matrix[fine].astype(np.int64)


class Block:
    """An unpacked block."""

    def __init__(self, dim: int, n: int, largest: float, ids: bytes, components: bytes, statistics: bytes):
        self.ids, self.n, self.dim, self.largest = np.frombuffer(ids, "<i8"), n, dim, largest
        self.components = np.frombuffer(components, "<i8").reshape(n, dim)
        self.statistics = np.frombuffer(statistics, "<f8").reshape(n, -1)
        self.norm = np.sqrt((self.components.astype(np.float64) ** 2).sum(axis=1))

    def level(self, number: int) -> np.ndarray:
        before = sum(2 * s for s in levels_of(self.dim)[:number])
        return self.statistics[:, before:before + 2 * levels_of(self.dim)[number]]


def products(a: Block, b: Block, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> np.ndarray:
    """Exact integer products, of all pairs or of the given ones: in doubles or longs where these are exact, else in
    Python's integers. A score that fits no long becomes the least or largest one, see ``Best.rows``."""
    bound = a.largest * b.largest * max(1, a.dim)
    kind = np.float64 if bound < 2.0**53 else np.int64 if bound < 2.0**62 else object
    x, y = a.components.astype(kind), b.components.astype(kind)
    if rows is None and kind is not object:
        return (x @ y.T).astype(np.int64)
    if rows is None:
        return np.concatenate([_longs(x[at:at + 64] @ y.T) for at in range(0, a.n, 64)])
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 65_536):
        cut = slice(at, at + 65_536)
        if kind is object:
            out[cut] = _longs((x[rows[cut]] * y[columns[cut]]).sum(axis=1))
        else:
            out[cut] = np.einsum("ij,ij->i", x[rows[cut]], y[columns[cut]]).astype(np.int64)
    return out


def _longs(exact: np.ndarray) -> np.ndarray:
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def survivors(queries: Block, block: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, block rows) whose bounds reach ``least`` at every resolution, coarse to fine."""
    slack = 1e-9 * queries.norm[:, None] * block.norm[None, :] + 1.0
    rows = columns = None
    for number in range(len(levels_of(queries.dim))):
        a, b = queries.level(number), block.level(number)
        if rows is None:
            rows, columns = np.nonzero(a @ b.T + slack >= least[:, None])
        else:
            bound = np.einsum("ij,ij->i", a[rows], b[columns]) + slack[rows, columns]
            fine = bound >= least[rows]
            rows, columns = rows[fine], columns[fine]
        if number == 0 and len(rows) > slack.size // 4 and len(levels_of(queries.dim)) > 1:
            last = len(levels_of(queries.dim)) - 1  # too many for pairwise steps: the finest bound for all at once
            rows, columns = np.nonzero(queries.level(last) @ block.level(last).T + slack >= least[:, None])
            break
        if not len(rows):
            break
    return rows, columns


class Best:
    """The k best (score descending, id ascending) of each query of a block, so far."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((queries.n, k), LEAST)
        self.ids = np.full((queries.n, k), MOST)
        self.filled = np.zeros(queries.n, np.int64)
        self.whole = 0

    def add(self, block: Block) -> None:
        least = np.where(self.filled >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)
        rows = columns = None
        if not np.isinf(least).all():
            if self.whole:
                self.whole -= 1
            else:
                rows, columns = survivors(self.queries, block, least)
                if len(rows) > LOOSE_SHARE * self.queries.n * block.n:
                    self.whole, rows = LOOSE_BLOCKS, None
        if rows is None:
            every = products(self.queries, block)
            rows, columns = np.nonzero(every >= self.scores[:, -1:])
            scores = every[rows, columns]
        else:
            scores = products(self.queries, block, rows, columns)
        ids = block.ids[columns]
        fine = (ids != self.queries.ids[rows]) & (scores >= self.scores[rows, -1])
        rows, ids, scores = rows[fine], ids[fine], scores[fine]
        have = np.arange(self.k)[None, :] < self.filled[:, None]
        rows = np.concatenate([np.nonzero(have)[0], rows])
        ids, scores = np.concatenate([self.ids[have], ids]), np.concatenate([self.scores[have], scores])
        order = np.lexsort((ids, ~scores, rows))  # ~ falls as - does, without an overflow
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.scores[rows[keep], place[keep]] = scores[keep]
        self.ids[rows[keep], place[keep]] = ids[keep]
        self.filled = np.minimum(np.bincount(rows, minlength=self.queries.n), self.k)

    def rows(self) -> Iterator[tuple]:
        for row in range(self.queries.n):
            for place in range(int(self.filled[row])):
                if self.scores[row, place] in (LEAST, MOST):
                    raise OverflowError("a score does not fit a long")
                yield int(self.queries.ids[row]), int(self.ids[row, place]), int(self.scores[row, place])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: every usable vector in blocks with its statistics, written to the shared folder."""
    lanes = shuffle_partitions(vectors.sparkSession)
    return written(pack_blocks(vectors, lanes, id_col, vector_col, block_rows), "segments")


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the ``k`` highest products, ties to the smaller id.

    Null ids, null vectors and vectors with null or non-finite components take no part, on either side. Only vectors
    of the query's length are compared. Rows with the query's id are its own row; a query id that repeats is asked
    once, with its largest vector. An empty side gives no rows. A component or a reported score that does not fit a
    long raises: it has no right answer.
    """
    spark = index.sparkSession
    lanes = shuffle_partitions(spark)
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")
                           ).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    packed = written(pack_blocks(asked, 1, "vec_id", "vector", block_rows).drop("lane"), "queries")
    held = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = -(-held // QUERIES_HELD) or 1
    body = ["dim", "n", "largest", "ids", "components", "statistics"]
    held_blocks = packed.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("part"),
                                F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
                                F.lit(0).alias("side"), *body)
    passing = index.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "lane",
                           F.lit(1).alias("side"), *body)
    # In a task, the queries of a group come before the blocks that pass them.
    meetings = (held_blocks.unionByName(passing).repartition(lanes * min(groups, 8), "part", "lane")
                .sortWithinPartitions("part", "lane", "dim", "side"))

    def make():
        def run(batches) -> Iterator[tuple]:
            now, best = None, []
            for part, lane, side, dim, *pack in rows_of(batches, 1):
                if now != (part, lane, dim):
                    for done in best:
                        yield from done.rows()
                    now, best = (part, lane, dim), []
                block = Block(dim, *pack)
                if side:
                    for one in best:
                        one.add(block)
                else:
                    best.append(Best(block, k))
            for done in best:
                yield from done.rows()

        return run

    hits = arrow_map(meetings, make, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import segment_search
from emberlog.llm.segment_search import Best, Block, build_index, segment_statistics, survivors, top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    usable = {}
    vectors = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows
               if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in vectors:
        if i % 5 == 0:
            hits = sorted((-int(v @ w), j) for j, w in vectors if j != i and len(w) == len(v))[:k]
            usable[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(hits)]
    return {i: v for i, v in usable.items() if v}


@pytest.mark.parametrize("dim", [1, 6, 64])
def test_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(300, dim)).round(2)
    base[100:150] = base[7]  # one common vector
    rows = [(i, base[i].tolist(), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [float("nan")] * dim, "x"), (305, [None] * dim, "x"), (None, base[0].tolist(), "x"),
             (310, [float("inf")] * dim, "x"), (315, [1.0] * (dim + 1), "x"), (316, [2.0] * (dim + 1), "x"), (320, [], "x")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = top_k(build_index(table, block_rows=32), table.filter("vec_id % 5 = 0"), 10, block_rows=16).collect()
    mine = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert mine == brute(rows, 10)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(segment_search, "QUERIES_HELD", 20)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(rng.normal(size=(400, 8)).round(2))]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = top_k(build_index(table, block_rows=32), table.filter("vec_id % 5 = 0"), 10, block_rows=8).collect()
    mine = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert mine == brute(rows, 10)


def block_of(ints, first=0):
    ints = np.asarray(ints, np.int64)
    return Block(ints.shape[1], len(ints), float(np.abs(ints).max()), np.arange(first, first + len(ints)).tobytes(),
                 ints.astype("<i8").tobytes(), segment_statistics(ints.astype(float)).tobytes())


def test_scores_near_the_largest_long(spark):
    big = 2**31
    ints = [[big, 0, 0], [big - 1, 5, 1], [-big, 7, 0], [3, 1, 2], [big - 1, -5, 1]]
    best = Best(block_of(ints[:1]), 3)
    best.add(block_of(ints))
    assert list(best.rows()) == [(0, 1, big * (big - 1)), (0, 4, big * (big - 1)), (0, 3, 3 * big)]
    far = [[2**40, 0, 0], [-2**40, 1, 0], [0, 1, 1]]  # scores beyond all longs are ordered, but not reported
    best = Best(block_of(far[:1]), 1)
    best.add(block_of(far))
    assert list(best.rows()) == [(0, 2, 0)]
    best = Best(block_of(far[:1]), 2)
    best.add(block_of(far))
    with pytest.raises(OverflowError):
        list(best.rows())
    with pytest.raises(OverflowError):
        best = Best(block_of([[2**40, 1, 1]], 9), 2)
        best.add(block_of([[2**40, 1, 0]]))
        list(best.rows())
    huge = spark.createDataFrame([(0, [0.5], ""), (1, [2.0**43], ""), (2, [-4.0], "")],
                                 "vec_id long, embedding array<double>, score string")
    found = top_k(build_index(huge), huge.filter("vec_id = 0"), 2)  # 2^53 is no exact double's neighbour any more
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 2**62), (0, 2, 2, -(2**21))]
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(build_index(huge.withColumn("embedding", F.expr("transform(embedding, x -> x * 1e30)"))), huge, 2).collect()


@pytest.mark.parametrize("walk", [True, False])
def test_bounds_and_whole_products_agree(walk):
    rng = np.random.default_rng(4)
    ints = rng.integers(-300, 300, (600, 64))
    ints = np.cumsum(ints, axis=1) if walk else ints
    best = Best(block_of(ints[:40]), 5)
    for at in range(0, 600, 20):
        best.add(block_of(ints[at:at + 20], at))
    exact = ints[:40] @ ints.T
    want = [(q, j, int(exact[q, j])) for q in range(40)
            for j in sorted((j for j in range(600) if j != q), key=lambda j: (-exact[q, j], j))[:5]]
    assert list(best.rows()) == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    ints = np.cumsum(rng.integers(-300, 300, (400, 64)), axis=1)
    block = Block(64, 400, float(np.abs(ints).max()), np.arange(400).tobytes(), ints.astype("<i8").tobytes(),
                  segment_statistics(ints.astype(float)).tobytes())
    exact = ints @ ints.T
    least = np.sort(exact, axis=1)[:, -10].astype(float)
    rows, columns = survivors(block, block, least)
    assert set(zip(*np.nonzero(exact >= least[:, None]))) <= set(zip(rows, columns))
    assert len(rows) < exact.size / 3


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, [1.0, 2.0], "")], SCHEMA)
    assert top_k(build_index(none), some).count() == 0
    assert top_k(build_index(some), none).count() == 0
    assert top_k(build_index(some), some).agg(F.count("*")).first()[0] == 0

"""Running totals and anchored windows against plain loops, with keys cut over many blocks."""

import random

import pytest

from emberlog.operators import ordered as scans
from emberlog.operators.ordered import BLOCK, KEY, TIME, anchored_nth, range_ordered, running_total


def rows_of(shape, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        if shape == "hot":        # one key holds most rows and spans all blocks
            key, us = ("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}"), rng.randrange(40_000)
        elif shape == "dense":    # whole blocks inside one window, many equal times
            key, us = "only", rng.randrange(300)
        elif shape == "sparse":   # gaps wider than the window
            key, us = f"k{rng.randrange(2)}", rng.randrange(5_000_000)
        else:                     # periodic: chains from different openers never meet
            key, us = "tick", i * 10
        rows.append((key, us, i))
    return rows


def anchored_by_loop(rows, gap, nth):
    chosen, state = [], {}
    for key, us, i in sorted(rows):
        anchor, count = state.get(key, (None, 0))
        anchor, count = (us, 1) if anchor is None or us - anchor > gap else (anchor, count + 1)
        state[key] = (anchor, count)
        if count == nth:
            chosen.append(i)
    return sorted(chosen)


@pytest.mark.parametrize("shape", ["hot", "dense", "sparse", "periodic"])
@pytest.mark.parametrize("gap,nth", [(100, 1), (100, 3), (95, 2), (2_000, 10)])
def test_anchored_windows_match_a_loop(spark, shape, gap, nth):
    rows = rows_of(shape, 7)
    frame = spark.createDataFrame(rows, f"{KEY} string, {TIME} bigint, id bigint")
    ordered = range_ordered(frame.repartition(5), TIME, "id")
    assert ordered.select(BLOCK).distinct().count() > 4
    for fan_in in (2, 8):
        found = sorted(row.id for row in anchored_nth(ordered, gap, nth, fan_in).collect())
        assert found == anchored_by_loop(rows, gap, nth)


@pytest.mark.parametrize("seed", range(4))
def test_anchored_windows_on_random_shapes(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), rng.randrange(rng.choice([50, 5_000, 100_000])), i) for i in range(900)]
    frame = spark.createDataFrame(rows, f"{KEY} string, {TIME} bigint, id bigint")
    ordered = range_ordered(frame, TIME, "id")
    for gap in (0, 1, 37, 400, 60_000):
        for nth in (1, 2, 7):
            found = sorted(row.id for row in anchored_nth(ordered, gap, nth).collect())
            assert found == anchored_by_loop(rows, gap, nth), (gap, nth)


def test_no_rows(spark):
    frame = spark.createDataFrame([], f"{KEY} string, {TIME} bigint, id bigint")
    assert anchored_nth(range_ordered(frame, TIME, "id"), 5, 1).count() == 0


@pytest.mark.parametrize("shape", ["hot", "dense", "sparse"])
def test_running_total_matches_a_loop(spark, shape):
    rows = [(key, us, i, i % 3) for key, us, i in rows_of(shape, 3)]
    frame = spark.createDataFrame(rows, f"{KEY} string, {TIME} bigint, id bigint, v bigint")
    counted = running_total(range_ordered(frame, TIME, "id"), "v", "total", TIME, "id")
    sums, expected = {}, {}
    for key, _, i, value in sorted(rows):
        sums[key] = sums.get(key, 0) + value
        expected[i] = sums[key]
    assert {row.id: row.total for row in counted.select("id", "total").collect()} == expected


def test_hot_key_is_spread_over_blocks(spark):
    frame = spark.createDataFrame([("hot", 5, i) for i in range(4000)], f"{KEY} string, {TIME} bigint, id bigint")
    sizes = [row["count"] for row in range_ordered(frame, TIME, "id").groupBy(BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4000 / 3


def test_one_key_over_many_blocks_meets_in_small_groups(spark):
    rng = random.Random(11)
    rows = [("only", rng.randrange(20_000), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, f"{KEY} string, {TIME} bigint, id bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ordered = range_ordered(frame, TIME, "id")
        assert ordered.select(BLOCK).distinct().count() > 50
        tree = scans._window_tree(ordered, 90, 4)
        assert len(tree) == 4 and tree[-1].count() == 1
        for level in tree[:-1]:
            groups = scans._with_parent(level, 4).groupBy(KEY, "parent").count().collect()
            assert max(row["count"] for row in groups) <= 4
        for nth in (1, 5):
            found = sorted(row.id for row in anchored_nth(ordered, 90, nth, 4).collect())
            assert found == anchored_by_loop(rows, 90, nth)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("seed", range(30))
def test_composed_functions_equal_both_in_turn(seed):
    import numpy as np
    rng = random.Random(seed)
    times = np.sort(np.array([rng.randrange(rng.choice([60, 400, 3000])) for _ in range(90)]))
    gap = rng.choice([0, 5, 40, 300])
    parts = [part for part in np.split(times, sorted(rng.sample(range(1, 90), 3)))]
    functions = [(*map(np.array, scans._window_exits(part, gap)), len(part)) for part in parts]
    whole = functions[0]
    for function in functions[1:]:
        whole = scans._composed(whole, function, gap)
    for anchor in (scans.NEVER, *range(int(times[0]) - gap, int(times[0]) + 1)):
        state = (anchor, 3)
        for function in functions:
            state = scans._through(function, *state, gap)
        assert scans._through(whole, anchor, 3, gap) == state

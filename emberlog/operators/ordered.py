"""Sequential logic over one global sort, without putting a key into one task.

``range_ordered`` cuts the rows into balanced blocks by sampled ranges of (key, order). A hot key
spans many blocks. Each block is scanned on its own and only one small summary row a block travels
on, so running totals and anchored windows stay exact whatever the skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from emberlog.session import materialize

KEY, TIME, BLOCK = "_key", "_us", "_block"
#: Block functions that one group composes at most, whatever number of blocks a key has.
FAN_IN = 8
#: Stands for no window yet, and for an end that no time reaches.
NEVER, ALWAYS = -(2 ** 62), 2 ** 62
WINDOWS = "_key string, node bigint, opens boolean, upto array<bigint>, exit array<bigint>, exit_rows array<bigint>, size bigint"


def row_key(*columns: str) -> Column:
    """One sortable, null-safe key out of several columns."""
    return F.to_json(F.struct(*columns))


def range_ordered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by (key, order) over all blocks; written once so that blocks never move.

    Add a unique last column to ``order``: then even one key at one instant is cut into blocks. The
    number of blocks is ``spark.sql.shuffle.partitions``; set it so that a block fits a task.
    """
    return materialize(
        df.repartitionByRange(KEY, *order)
        .sortWithinPartitions(KEY, *order)
        .withColumn(BLOCK, F.spark_partition_id()))


def running_total(ordered: DataFrame, value: str, result: str, *order: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key over a ``range_ordered`` frame, in place: no row moves.

    Only the first key of a block can continue from the block before, so what a block needs from the others is
    one number, added up over at most two rows a block.
    """
    kind = "_block int, _key string, opens boolean, total bigint"

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, totals = None, {}
        first = last = None
        for batch in batches:
            for start, end in _runs(batch[KEY].to_numpy()):
                block, key = int(batch[BLOCK].iloc[0]), batch[KEY].iloc[start]
                first = key if first is None else first
                if key != last and last is not None and last != first:
                    del totals[last]
                last = key
                totals[key] = totals.get(key, 0) + int(batch[value].iloc[start:end].sum())
        rows = [(block, key, key == first, total) for key, total in totals.items()]
        yield pd.DataFrame(rows, columns=[BLOCK, KEY, "opens", "total"])

    before = (Window.partitionBy(KEY).orderBy(BLOCK)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (ordered.select(BLOCK, KEY, value).mapInPandas(ends, kind)
               .withColumn("_carried", F.coalesce(F.sum("total").over(before), F.lit(0)))
               .filter("opens").select(BLOCK, "_carried"))
    # At most one row per block: the size is bound by the number of partitions.
    seeded = ordered.join(F.broadcast(carried), BLOCK, "left")
    columns = [*ordered.columns, result]
    schema = StructType([*ordered.schema.fields, StructField(result, LongType())])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carry = None, 0
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[KEY].to_numpy()
            sums = batch[value].to_numpy().astype(np.int64).cumsum()
            if last is None:
                last, carry = keys[0], int(batch["_carried"].iloc[0])
            spans = _runs(keys)
            offsets = [0 if start == 0 else int(sums[start - 1]) for start, _ in spans]
            sums -= np.repeat(offsets, [end - start for start, end in spans])
            if keys[0] == last:
                sums[:spans[0][1]] += carry
            last, carry = keys[-1], int(sums[-1])
            yield batch.assign(**{result: sums})[columns]

    return seeded.mapInPandas(add, schema)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of equal keys."""
    if not len(keys):
        return []
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def anchored_nth(ordered: DataFrame, gap_us: int, nth: int, fan_in: int = FAN_IN) -> DataFrame:
    """The ``nth`` row of every anchored window of a ``range_ordered`` frame.

    A window opens at a key's first row and takes the rows up to ``gap_us`` after it; the first row
    later than that opens the next window. With ``nth=1`` this selects rows that are each more than
    ``gap_us`` after the one selected before.
    """
    entries = _incoming_windows(ordered, gap_us, fan_in)
    # At most one row per block: the size is bound by the number of partitions.
    seeded = ordered.join(F.broadcast(entries), BLOCK, "left")
    columns = ordered.columns
    schema = ordered.schema

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, count = None, None, 0
        for batch in batches:
            if batch.empty:
                continue
            if key is None and pd.notna(batch["anchor"].iloc[0]):
                key = batch[KEY].iloc[0]
                anchor, count = int(batch["anchor"].iloc[0]), int(batch["count"].iloc[0])
            chosen = []
            keys, times = batch[KEY].to_numpy(), batch[TIME].to_numpy()
            for position, end in _runs(keys):
                if keys[position] != key:
                    key, anchor, count = keys[position], None, 0
                while position < end:  # from window to window, not from row to row
                    if anchor is None or times[position] - anchor > gap_us:
                        anchor, count = int(times[position]), 0
                    upto = position + int(np.searchsorted(times[position:end], anchor + gap_us, side="right"))
                    if count < nth <= count + upto - position:
                        chosen.append(position + nth - count - 1)
                    count, position = count + upto - position, upto
            yield batch[columns].iloc[chosen]

    return seeded.mapInPandas(pick, schema)


def _incoming_windows(ordered: DataFrame, gap_us: int, fan_in: int) -> DataFrame:
    """For each block that continues a key: the window (anchor, rows so far) open at its start.

    A block maps the window open before it to the one open at its end. These functions are composed up a tree, ``fan_in``
    neighbours a group, and the windows walk down it again: no group ever holds more than ``fan_in`` blocks of a key.
    """
    tree = _window_tree(ordered, gap_us, fan_in)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("node")
        anchor, count, found = int(rows["anchor"].iloc[0]), int(rows["count"].iloc[0]), []
        for row in rows.itertuples(index=False):
            found.append((row[0], row.node, anchor, count))
            anchor, count = _through((row.upto, row.exit, row.exit_rows, int(row.size)), anchor, count, gap_us)
        return pd.DataFrame(found, columns=[KEY, "node", "anchor", "count"])

    entering = tree[-1].select(KEY, "node", F.lit(NEVER).alias("anchor"), F.lit(0).cast("bigint").alias("count"))
    for level in reversed(tree[:-1]):
        above = entering.withColumnRenamed("node", "parent")
        entering = (_with_parent(level, fan_in).join(above, [KEY, "parent"])
                    .groupBy(KEY, "parent").applyInPandas(walk, "_key string, node bigint, anchor bigint, count bigint"))
    return entering.filter(F.col("anchor") != NEVER).select(F.col("node").cast("int").alias(BLOCK), "anchor", "count")


def _window_tree(ordered: DataFrame, gap_us: int, fan_in: int) -> list[DataFrame]:
    """Functions of blocks, of groups of blocks, of groups of these, up to one a key."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, first, head, last = None, None, [], None
        anchor, count = None, 0
        for batch in batches:
            if batch.empty:
                continue
            keys, times = batch[KEY].to_numpy(), batch[TIME].to_numpy()
            if first is None:
                block, first = batch[BLOCK].iloc[0], keys[0]
            if last is None:
                ended = np.flatnonzero(keys != first)
                cut = int(ended[0]) if len(ended) else len(keys)
                head.append(times[:cut])
                keys, times = keys[cut:], times[cut:]
            if len(keys):
                # Only the window open at the end matters: of the last key, from where it begins.
                others = np.flatnonzero(keys != keys[-1])
                start = int(others[-1]) + 1 if len(others) else 0
                if start or keys[-1] != last:
                    last, anchor, count = keys[-1], None, 0
                anchor, count = _advance(times[start:], anchor, count, gap_us)
        if first is not None:
            own = np.concatenate(head)
            rows = [(first, block, False, *_window_exits(own, gap_us), len(own))]
            if last is not None:  # nothing comes before it, so whatever comes in, this goes out
                rows.append((last, block, True, [ALWAYS], [anchor], [count], 0))
            yield pd.DataFrame(rows, columns=[KEY, "node", "opens", "upto", "exit", "exit_rows", "size"])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("node")
        whole = None
        for row in rows.itertuples(index=False):
            one = (np.asarray(row.upto), np.asarray(row.exit), np.asarray(row.exit_rows), int(row.size))
            whole = one if whole is None else _composed(whole, one, gap_us)
        upto, exits, exit_rows, size = whole
        return pd.DataFrame([(rows[KEY].iloc[0], rows["parent"].iloc[0], bool(rows["opens"].iloc[0]), upto.tolist(),
                              exits.tolist(), exit_rows.tolist(), size)],
                            columns=[KEY, "node", "opens", "upto", "exit", "exit_rows", "size"])

    tree = [materialize(ordered.select(BLOCK, KEY, TIME).mapInPandas(summarise, WINDOWS))]
    last = tree[0].agg(F.max("node")).first()[0] or 0
    while last > 0 or len(tree) == 1:
        tree.append(_with_parent(tree[-1], fan_in).groupBy(KEY, "parent").applyInPandas(compose, WINDOWS))
        last //= fan_in
    return tree


def _with_parent(nodes: DataFrame, fan_in: int) -> DataFrame:
    return nodes.withColumn("parent", F.expr(f"node div {fan_in}"))


def _through(function: tuple, anchor: int, count: int, gap_us: int) -> tuple[int, int]:
    """The window (anchor, rows) that leaves a block, from the one that enters it."""
    upto, exits, exit_rows, size = function
    step = int(np.searchsorted(upto, NEVER if anchor == NEVER else anchor + gap_us, "right"))
    return (int(exits[step]), int(exit_rows[step])) if step < len(exits) else (anchor, count + size)


def _composed(one: tuple, two: tuple, gap_us: int) -> tuple:
    """``two`` after ``one``: where ``one`` closes the window, ``two`` goes on from its exit, else from what came in."""
    step = np.searchsorted(two[0], one[1] + gap_us, "right")
    closed = step < len(two[0])
    at = np.minimum(step, len(two[0]) - 1)
    late = two[0] > one[0][-1]
    upto = np.concatenate([one[0], two[0][late]])
    exits = np.concatenate([np.where(closed, two[1][at], one[1]), two[1][late]])
    rows = np.concatenate([np.where(closed, two[2][at], one[2] + two[3]), two[2][late]])
    last_of_step = np.append((exits[1:] != exits[:-1]) | (rows[1:] != rows[:-1]), True)
    return upto[last_of_step], exits[last_of_step], rows[last_of_step], one[3] + two[3]


def _advance(times: np.ndarray, anchor: int | None, count: int, gap_us: int) -> tuple[int, int]:
    """The window open after some more rows of a key: its first time and its rows so far."""
    position = 0
    while position < len(times):
        if anchor is None or times[position] - anchor > gap_us:
            anchor, count = int(times[position]), 0
        end = int(np.searchsorted(times, anchor + gap_us, side="right"))
        count, position = count + end - position, end
    return anchor, count


def _window_exits(times: np.ndarray, gap_us: int) -> tuple[list[int], list[int], list[int]]:
    """Last window of a run of rows, as a step function of the row that opens its first window.

    A window open before the run ends at most ``gap_us`` after the run's first row, so only the rows
    up to there can open the first one. Openers that lead to the same last window share one step.
    """
    following = np.searchsorted(times, times + gap_us, side="right")
    openers = min(int(following[0]) + 1, len(times))
    # Only the earliest of several rows at one instant can open a window.
    start = np.unique(np.searchsorted(times, times[:openers], side="left"))
    # A row more than ``gap_us`` after its predecessor opens a window in any case.
    certain = np.flatnonzero(np.diff(times) > gap_us) + 1
    current = np.maximum(start, certain[-1]) if len(certain) else start.copy()
    while True:
        moved = following[current]
        inside = moved < len(times)
        if not inside.any():
            break
        current = np.where(inside, moved, current)
    last_of_step = np.append(current[1:] != current[:-1], True)
    exits = current[last_of_step]
    return times[start[last_of_step]].tolist(), times[exits].tolist(), (len(times) - exits).tolist()

"""Structure repair of conversations by a shortest path over scalar weights.

A repair walks over a conversation's rows and keeps, re-roles or deletes each, inserting empty turns between them, so
that the roles read ``(s?(ua)+)?`` by their initials. Nodes are (rows done, last initial written); every edit is an
edge. A path's weight is one integer: its high digits add up the costs, and below them each edit writes its letter as a
digit at its own place from the left, the rest being zeros. So the least integer is the cheapest repair and, among
those, the one whose letters come first in order; no tie is ever left.

Paths to one node may differ in length through insertions, and their next letters then go to different places. The
least one still wins whatever follows: letters of equally dear paths differ before either ends, since a path that only
goes on from another costs more.

A conversation may be of any length. Rows are sorted by conversation and turn and cut into blocks wherever they fall; a
block gives the least path from each initial before it to each after it, and blocks are chained. Texts take no part in
that: they meet their edits in one sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import materialize

from .common import arrow_map, rows_of

#: What edits cost, what an undeleted truncated row costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of the audit in ASCII order, as digits from 1 on.
LETTERS = "DIKR"
DIGIT = 3
#: Initials written last: none yet, system, user, assistant; where each may lead, and where a repair may end.
STATES = "-sua"
FOLLOWS = {"-": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "-a"
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a block at most: integers have about 7 bits a row.
BLOCK_ROWS = 1_024
FRAGMENTS = """conv_id long, block long, n_blank long, n_duplicate long, n_truncated long, n_illegal long,
               first string, last string, paths array<struct<entry: string, exit: string, cost: long, audit: binary>>"""
REPAIRED = """conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,
              audit string, repaired_sha256 string"""


class Row(NamedTuple):
    """What the repair needs of a row: the initial of its role, and its first fault."""

    initial: str
    fault: str | None


def least_paths(rows: list[Row], entries: str = STATES) -> dict[tuple[str, str], tuple[int, str]]:
    """(cost, audit) of the least path over ``rows`` from each entry to each exit.

    A block's path may insert after its last row, never before its first one, so blocks chain without a choice.
    """
    n = len(rows)
    places = n + (DELETE * n + INSERT * 3) // INSERT + 3  # no least path to a node has more letters
    unit = 1 << DIGIT * places
    digit = [[(LETTERS.index(letter) + 1) << DIGIT * (places - 1 - at) for at in range(places)] for letter in LETTERS]
    deletes, inserts, keeps, reroles = digit
    found = {}
    for entry in entries:
        here: dict[str, tuple[int, int]] = {entry: (0, 0)}  # weight, letters so far
        for row in rows:
            after: dict[str, tuple[int, int]] = {}

            def reach(state: str, weight: int, length: int, after=after) -> None:
                if state not in after or weight < after[state][0]:
                    after[state] = weight, length

            for state, (weight, length) in here.items():
                reach(state, weight + DELETE * unit + deletes[length], length + 1)
                if row.fault in ("blank", "duplicate"):
                    continue
                kept = weight + (TRUNCATED * unit if row.fault == "truncated" else 0)
                for target in FOLLOWS[state]:
                    if target == row.initial:
                        reach(target, kept + keeps[length], length + 1)
                    elif target in ROLES:
                        reach(target, kept + REROLE * unit + reroles[length], length + 1)
            here = insert_turns(after, unit, inserts)
        for exit_, (weight, length) in here.items():
            low = weight % unit >> DIGIT * (places - length)
            audit = "".join(LETTERS[(low >> DIGIT * k & 7) - 1] for k in range(length - 1, -1, -1))
            found[entry, exit_] = weight // unit, audit
    return found


def insert_turns(here: dict[str, tuple[int, int]], unit: int, inserts: list[int]) -> dict[str, tuple[int, int]]:
    """The nodes of a layer after any insertions; no least path inserts more than there are states."""
    for _ in range(len(STATES)):
        for state, (weight, length) in list(here.items()):
            for target in FOLLOWS[state]:
                if target in ROLES:
                    longer = weight + INSERT * unit + inserts[length]
                    if target not in here or longer < here[target][0]:
                        here[target] = longer, length + 1
    return here


def open_paths() -> dict[str, tuple[int, bytes]]:
    """Least paths before the first row: nothing, or turns inserted there."""
    return {"-": (0, b""), "u": (INSERT, b"I"), "a": (2 * INSERT, b"II")}


def chained(before: dict[str, tuple[int, bytes]], paths) -> dict[str, tuple[int, bytes]]:
    """Least paths after one more block; equal costs go by letters, as the digits below them would."""
    after: dict[str, tuple[int, bytes]] = {}
    for entry, exit_, cost, audit in paths:
        if entry in before:
            way = before[entry][0] + cost, before[entry][1] + audit
            if exit_ not in after or way < after[exit_]:
                after[exit_] = way
    return after


def illegal(before: str | None, after: str) -> int:
    return int(before is not None and f"{before}{after}" not in ("su", "ua", "au"))


def word_character(text: Column) -> Column:
    """The last character that is no blank or control blank; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults put in: by the CRC-32 of ``conv_id:turn`` modulo 20,
    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user. Nulls in
    role, text and the checksum's two parts count as one blank."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault, copies) of distinct rows; the first of equal rows has ``fault``, its copies
    are duplicates. Texts go by their SHA-256. Copies are counted before they are shuffled."""
    last = word_character(F.col("text"))
    own = F.when(last.isNull(), "blank").when(~last.isin(".", "!", "?"), "truncated")
    distinct = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), own.alias("own")).groupBy(
        "conv_id", "turn", "role", "digest", "own").agg(F.count("*").alias("copies"))
    turn = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    first = distinct.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    late = turn > F.col("first")
    return distinct.join(first, same).select(
        "conv_id", "turn", "role", "digest", "copies",
        F.when(F.col("own") == "blank", "blank").when(late, "duplicate").otherwise(F.col("own")).alias("fault"))


def fragments(marks: DataFrame) -> DataFrame:
    """Counts and least paths of blocks of conversations: sorted ranges of rows, whatever conversation they are of."""
    order = [F.col(name).asc_nulls_first() for name in ("conv_id", "turn", "role", "digest")]
    ordered = materialize(marks.repartitionByRange(*order).sortWithinPartitions(*order))

    def make():
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def run(batches) -> Iterator[tuple]:
            held: list[Row] = []
            last: tuple | None = None
            block = number

            def out() -> tuple:
                faults = [row.fault for row in held]
                paths = [(entry, exit_, cost, audit.encode())
                         for (entry, exit_), (cost, audit) in sorted(least_paths(held).items())]
                initials = [row.initial for row in held]
                return (last[0], block, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                        sum(map(illegal, initials, initials[1:])), initials[0], initials[-1], paths)

            for conv_id, _, role, _, copies, fault in rows_of(batches):
                if last is not None and last[0] != conv_id and held:
                    yield out()
                    block, held = block + 1, []
                last = (conv_id,)
                for copy in range(copies):
                    if len(held) == BLOCK_ROWS:
                        yield out()
                        block, held = block + 1, []
                    held.append(Row(role[:1], "duplicate" if copy and fault != "blank" else fault))
            if held:
                yield out()

        return run

    return arrow_map(ordered.select("conv_id", "turn", "role", "digest", "copies", "fault"), make, FRAGMENTS)


def repair_conversations(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every ``conv_id`` of
    ``conversations``, whose rows (conv_id, turn, role, text) are ``rows``, by default its own.

    Rows go by turn, null ones first; rows of one turn go by role and by the SHA-256 of their text. Null roles and texts
    count as one blank, null ids are one conversation, repeated rows are duplicates, other columns are ignored.
    Conversations without rows get zeros, an empty audit and the hash of nothing; an empty table gives an empty one.
    A conversation's audit and hash are one value each, so one task writes them; it holds the audit, not the rows.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = (conversations if rows is None else rows).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")))
    blocks = fragments(marked(rows))
    nothing = {"turn": "long", "role": "string", "digest": "string", "text": "string"}
    found = "struct<" + ", ".join(f"{name}: {blocks.schema[name].dataType.simpleString()}"
                                  for name in blocks.columns[2:]) + ">"

    def row(frame: DataFrame, kind: int, **known: Column) -> DataFrame:
        return frame.select("conv_id", F.lit(kind).alias("kind"), *(
            known.get(name, F.lit(None).cast(of)).alias(name) for name, of in {**nothing, "found": found}.items()))

    stream = row(ids, 0).union(row(blocks, 1, turn=F.col("block"), found=F.struct(*blocks.columns[2:]))).union(
        row(rows, 2, turn=F.col("turn"), role=F.col("role"), digest=F.sha2("text", 256), text=F.col("text")))
    order = [F.col(name).asc_nulls_first() for name in ("conv_id", "kind", "turn", "role", "digest")]
    return arrow_map(stream.repartition("conv_id").sortWithinPartitions(*order), lambda: follow, REPAIRED)


class Writer:
    """Writes out a repair: the hash of its turns as rows and letters come along, and the turns' gaps."""

    def __init__(self, audit: bytes):
        self.audit, self.at, self.written = audit.decode(), 0, 0
        self.hash, self.state = hashlib.sha256(), "-"
        self.least = self.most = self.before = None
        self.turns = 0

    def write(self, state: str, line: str) -> None:
        self.hash.update(("\n" if self.written else "").encode() + line.encode())
        self.state, self.written = state, self.written + 1

    def insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            state = "a" if self.state == "u" else "u"
            self.write(state, f"{ROLES[state]}:")
            self.at += 1

    def take(self, turn: int | None, role: str, text: str) -> None:
        self.insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.write(role[:1], f"{role}:{text}")
        elif letter == "R":
            state = "a" if self.state == "u" else "u"
            self.write(state, f"{ROLES[state]}:{text}")
        if turn is not None:
            self.least, self.most = turn if self.least is None else self.least, turn
            self.turns += turn != self.before
            self.before = turn

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def follow(batches) -> Iterator[tuple]:
    """Repaired conversations of a sorted stream: each one's id, its blocks, its rows."""
    current: list | None = None  # conv_id, counts, paths, last initial, writer

    def out() -> tuple:
        conv_id, counts, _, _, writer = current
        cost, audit = settled(current)
        writer = writer or Writer(audit)
        writer.insert()
        return conv_id, writer.gaps(), *counts, cost, audit.decode(), writer.hash.hexdigest()

    def settled(of: list) -> tuple[int, bytes]:
        return min(path for state, path in of[2].items() if state in ENDS)

    for conv_id, kind, turn, role, _, text, found in rows_of(batches, 64):
        if kind == 0:
            if current is not None:
                yield out()
            current = [conv_id, [0, 0, 0, 0], open_paths(), None, None]
        elif kind == 1:
            counts = [found[name] for name in ("n_blank", "n_duplicate", "n_truncated", "n_illegal")]
            counts[3] += illegal(current[3], found["first"])
            current[1] = [a + b for a, b in zip(current[1], counts, strict=True)]
            current[2] = chained(current[2], [(p["entry"], p["exit"], p["cost"], p["audit"]) for p in found["paths"]])
            current[3] = found["last"]
        else:
            if current[4] is None:
                current[4] = Writer(settled(current)[1])
            current[4].take(turn, role, text)
    if current is not None:
        yield out()

import hashlib
import random
import re
import zlib

import duckdb

from emberlog.llm import conversation_repair as repair
from emberlog.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string"
SHAPE = re.compile("(s?(ua)+)?")


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0d]", text)
        out.append("blank" if not ends else "duplicate" if (role, text) in seen
                   else "truncated" if ends[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows, kinds):
    """The least (cost, audit, roles written) of all sequences of edits, tried one by one."""
    best = [(4 * len(rows), "D" * len(rows), ())]

    def go(at, cost, audit, written, inserted):
        if cost > best[0][0]:
            return
        if at == len(rows) and SHAPE.fullmatch("".join(x[0][:1] or "?" for x in written)):
            best[0] = min(best[0], (cost, audit, tuple(written)))
        if inserted < 4:
            for role in ("user", "assistant"):
                go(at, cost + 3, audit + "I", [*written, (role, "")], inserted + 1)
        if at == len(rows):
            return
        _, _, role, text = rows[at]
        go(at + 1, cost + 4, audit + "D", written, inserted)
        if kinds[at] not in ("blank", "duplicate"):
            more = 3 * (kinds[at] == "truncated")
            go(at + 1, cost + more, audit + "K", [*written, (role, text)], inserted)
            for new in ("user", "assistant"):
                go(at + 1, cost + more + 3, audit + "R", [*written, (new, text)], inserted)

    go(0, 0, "", [], 0)
    return best[0]


def longest_first(rows, kinds):
    """The same by a table of (cost, audit, written) for long conversations."""
    follows = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}
    names = {"u": "user", "a": "assistant"}

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, written) in list(table.items()):
                for to in follows[state]:
                    if to in names:
                        table[to] = min(table.get(to, (10**9,)), (cost + 3, audit + "I", (written, (names[to], ""))))
        return table

    table = inserts({"": (0, "", None)})
    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for state, (cost, audit, written) in table.items():
            ways = [(state, cost + 4, "D", written)]
            if kind not in ("blank", "duplicate"):
                more = cost + 3 * (kind == "truncated")
                ways += [(to, more, "K", (written, (role, text))) if to == role[:1]
                         else (to, more + 3, "R", (written, (names.get(to), text)))
                         for to in follows[state] if to == role[:1] or to in names]
            for to, price, letter, turns in ways:
                mark = price, audit + letter
                if to not in after or mark < after[to][:2]:
                    after[to] = *mark, turns
        table = inserts(after)
    cost, audit, chain = min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])
    written = []
    while chain:
        chain, turn = chain
        written.append(turn)
    return cost, audit, tuple(reversed(written))


def expected(rows, solve, spoil=True):
    out = []
    after = list(damaged(rows)) if spoil else [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    for conv_id in {row[0] for row in rows}:
        mine = sorted((row for row in after if row[0] == conv_id), key=lambda r: (
            r[1] is not None, r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        kinds = faults(mine)
        cost, audit, written = solve(mine, kinds)
        turns = [row[1] for row in mine if row[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        text = "\n".join(f"{role}:{text}" for role, text in written)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA)


def made(seed, conversations, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Yes. ", "漢字。", "so ", "Yes.", "a\nb."]
    return [(c if c else None, rng.choice([t, t, t, t + rng.randint(0, 3), None]), rng.choice(roles), rng.choice(texts))
            for c in range(conversations) for t in range(rng.randint(1, turns))]


def test_every_repair_of_short_conversations(spark):
    rows = made(1, 260, 4)
    conversations = frame(spark, rows)
    found = repair.repair_conversations(conversations, repair.damage(conversations)).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, every_repair)
    found = repair.repair_conversations(conversations).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, every_repair, spoil=False)


def test_long_conversations_cross_blocks(spark):
    rows = made(2, 30, 60) + [(77, t, random.Random(t).choice(["user", "assistant", "system"]), f"Text {t % 1900}.")
                              for t in range(5000)] + [(78, 5, "user", "Same.")] * 3000
    found = repair.repair_conversations(frame(spark, rows).repartition(6)).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, longest_first, spoil=False)


def test_blocks_chain_as_one():
    rng = random.Random(3)
    for _ in range(200):
        rows = [repair.Row(rng.choice("suaat"), rng.choice([None, None, "truncated", "blank"])) for _ in range(12)]
        cut = rng.randint(1, 11)
        whole, halves = repair.open_paths(), repair.open_paths()
        for part in (rows[:cut], rows[cut:]):
            halves = repair.chained(halves, [(a, b, c, d.encode()) for (a, b), (c, d) in repair.least_paths(part).items()])
        whole = repair.chained(whole, [(a, b, c, d.encode()) for (a, b), (c, d) in repair.least_paths(rows).items()])
        assert whole == halves


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    found = op12_conversation_repair(spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, longest_first)


def test_dropped_rows_and_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = frame(spark, [(dropped, 0, "user", "Hi.")])
    row = repair.repair_conversations(gone, repair.damage(gone)).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = frame(spark, [])
    assert repair.repair_conversations(empty, repair.damage(empty)).collect() == []

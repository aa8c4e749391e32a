import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import vector_packing as packing
from emberlog.llm.queries import op11_vector_packing
from emberlog.llm.vector_packing import Capacities


def one_by_one(items, capacities, rule, weights=packing.WEIGHTS):
    """Vector best fit as it is said: an item at a time over all sequences. Contents of the sequences, in order."""
    whole = capacities.vector()
    left, inside = [], []
    for length in sorted(items, reverse=True):
        demand = np.array([length, 1, length * length])
        best, least = None, None
        for k, rest in enumerate(left):
            if (rest >= demand).all():
                x = (((rest - demand) / whole) ** 2 if rule == "norm" else rest / whole * (demand / whole)) * np.array(weights)
                if least is None or x.sum() < least:
                    best, least = k, x.sum()
        if best is None:
            best = len(left)
            left.append(whole.copy())
            inside.append([])
        left[best] = left[best] - demand
        inside[best].append(length)
    return inside


def unrolled(runs):
    inside = defaultdict(list)
    for run in runs:
        for k in range(run.sequences):
            at = inside[run.sequence + k]
            assert sum(at) == run.offset
            at.extend([run.length] * run.each)
    return [inside[k] for k in range(len(inside))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacities", [Capacities(50), Capacities(50, 4), Capacities(50, None, 900), Capacities(64, 5, 1700)])
def test_plan_equals_best_fit_one_by_one(rule, capacities):
    rng = random.Random(7)
    for trial in range(25):
        top = rng.choice([3, 12, capacities.longest()])
        items = [rng.randint(1, top) for _ in range(rng.choice([0, 1, 30, 200]))] + [rng.randint(1, top)] * rng.choice([0, 90])
        runs = packing.plan_packing(dict(Counter(items)), capacities, rule)
        numbers = defaultdict(list)
        for run in runs:
            numbers[run.length].append((run.first, run.first + run.each * run.sequences))
        for length, n in Counter(items).items():
            spans = sorted(numbers[length])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        mine, theirs = unrolled(runs), one_by_one(items, capacities, rule)
        assert sorted(map(sorted, mine)) == sorted(map(sorted, theirs))
        for inside in mine:
            vector = np.array([sum(inside), len(inside), sum(x * x for x in inside)])
            assert (vector <= capacities.vector()).all()


def test_plan_is_short_and_full_for_billions():
    rng = np.random.default_rng(3)
    counts = {k: int(n) for k, n in enumerate(rng.integers(10**6, 10**7, 1024), 1)}
    runs = packing.plan_packing(counts)
    used = 1 + max(run.sequence + run.sequences - 1 for run in runs)
    least = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert len(runs) < 10_000 and used <= least * 1.005


SCHEMA = "doc_id long, text string, part long, length string, ids long"


def rows_of_texts():
    texts = ["one two three", "", None, "é ü 漢字  <|endoftext|> x", "long words " * 900, "word " * 1023, "word " * 1024,
             "word " * 2048, "same text"]
    return [(k if k % 11 else None, texts[k % len(texts)], k, "clash", k) for k in range(200)] + [(5, "same text", 1, "", 1)] * 300


@pytest.mark.parametrize("capacities", [Capacities(), Capacities(256, 7, 40_000)])
def test_pieces_and_places(spark, capacities):
    rows = rows_of_texts()
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), capacities).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = {text: [*library.encode(text or "", add_special_tokens=False).ids, 2] for text in {r[1] for r in rows}}
    wanted = Counter()
    size = capacities.longest()
    for doc_id, text, *_ in rows:
        ids, head = coded[text], (len(coded[text]) - 1) % size + 1
        cuts = [0, *range(head, len(ids) + 1, size)]
        wanted.update((doc_id, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in packed) == wanted
    inside = defaultdict(list)
    for r in packed:
        inside[r.sequence_id].append((r.offset, r.length))
    theirs = one_by_one([r.length for r in packed], capacities, "norm")
    assert sorted(sorted(n for _, n in x) for x in inside.values()) == sorted(map(sorted, theirs))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length


def test_sequences_hold_their_pieces(spark):
    packed = packing.pack_documents(spark.createDataFrame(rows_of_texts(), SCHEMA))
    for row in packing.sequences(packed).collect():
        assert len(row.ids) == 4 * sum(row.lengths) <= 4096 and len(row.doc_ids) == len(row.lengths)


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame(rows_of_texts(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op11_vector_packing(spark, str(tmp_path)).collect()
    assert {r.ids_crc32 for r in rows if r.length == 1 and r.start == r.piece == 0 and r.doc_id == 1} == {
        zlib.crc32(np.array([2], "<u4").tobytes())}
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_impossible_capacities():
    with pytest.raises(ValueError):
        Capacities(0).vector()
    with pytest.raises(ValueError):
        packing.plan_packing({60: 1}, Capacities(50))

import itertools
import random
import re

import pytest

from emberlog.llm import occurrence_join
from emberlog.llm.graph import components
from emberlog.llm.occurrence_join import jaccard_groups, keep_one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old = root[b]
            root = [root[a] if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    passage = rng.choices(vocabulary, k=60)
    rows, base = [], rng.choices(vocabulary, k=120)
    for k in range(260):
        kind = rng.random()
        if kind < 0.5:  # near copies of one text, some too far away
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.6 and rows:
            words = (rng.choice(rows)[1] or "").split()
        elif kind < 0.75:
            words = rng.choices(vocabulary, k=rng.randint(1, 60)) + passage
        else:
            words = rng.choices(vocabulary[:3], k=rng.randint(0, 9))
        rows.append((k * 3 + 1, " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "A b\x0bC d"), (5004, "a B c D"),
                   (5005, "é\xa0x y"), (5006, "word " * 30_000), (0, "word " * 29_000)]


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 400), (4, 85, 20), (5, 80, 50)])
def test_against_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(occurrence_join, "CLUSTER_BLOCK", block)
    rows = corpus(width + block)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, n int")
    found = jaccard_groups(docs.repartition(6), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, width, percent)


def test_common_shingles_and_odd_rows(spark):
    rows = corpus(9)  # one block: over 64 of its sets share shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_groups(docs.coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 4, 85)
    assert jaccard_groups(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None)], docs.schema)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_groups(twice).collect()) == [
        (-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[k] for k in range(41)}) == 1 and len({found[k] for k in (100, 101, 102)}) == 1
    assert found[0] != found[100]


def test_one_of_each_stays(spark):
    rows = corpus(13)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(4, rows[1][1], 1), (None, "a", 1), (None, "a", 1)],
                                 "doc_id long, text string, component_id int").union(
        spark.createDataFrame([(rows[0][0], rows[0][1], 2)], "doc_id long, text string, component_id int"))
    kept = occurrence_join.keep_one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    expected = sorted(i for i, _, c in brute([(i, t) for i, t in rows] + [(4, rows[1][1])], 4, 85) if i == c)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(expected))
    assert kept.filter("doc_id IS NULL").count() == 2


def test_packed_numbers_come_back():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        shingles = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) // np.uint64(7) * np.uint64(7) + np.uint64(3))
        packed = occurrence_join.pack_shingles(shingles, 3, 7)
        assert (occurrence_join.unpack_shingles(packed, 3, 7) == shingles).all()


def test_form_letters_spread_over_jobs(spark, monkeypatch):
    """Different texts with equal shared shingles, and so with the same prefix: one cluster."""
    monkeypatch.setattr(occurrence_join, "CLUSTER_BLOCK", 200)
    seen = []
    search_jobs = occurrence_join.search_jobs

    def watched(members, sizes):
        jobs = search_jobs(members, sizes)
        seen.extend(jobs.groupBy("job").count().collect())
        return jobs

    monkeypatch.setattr(occurrence_join, "search_jobs", watched)
    words = [f"w{k}" for k in range(120)]
    docs = spark.createDataFrame([(k, " ".join([*words[:60], f"name{k}", *words[60:]])) for k in range(3000)],
                                 "doc_id long, text string").repartition(4)
    assert {r.component_id for r in jaccard_groups(docs).collect()} == {0}
    assert len(seen) == 15 * 16 // 2 and max(r["count"] for r in seen) < 2.5 * 200


def test_sets_of_blocks_spread_over_buckets():
    import numpy as np
    sets = {b"0" * 16: np.arange(3, dtype=np.uint64)}
    homes = {next(occurrence_join.block_messages(sets, part << 32, 64))[0] for part in range(64)}
    assert len(homes) > 20


def test_repeated_ids_keep_unlike_texts(spark):
    a, b = (" ".join(f"{x}{n}" for n in range(30)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b + " more"), (None, a), (9, None), (9, "")]
    kept = keep_one_of_each(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, number long, row int"))
    assert kept.columns == ["doc_id", "text", "number", "row"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, a), (5, b), (None, a), (9, None), (9, "")], key=str)

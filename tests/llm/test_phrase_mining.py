import re
from collections import Counter

import pytest

from emberlog.llm import phrase_mining as mining

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, w string"


def brute(rows, least, covered=80, top=2000):
    """The contract, word by word."""
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        kept = []
        known = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        for p, a in known.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in known.items()):
                continue
            score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score)
                for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", "y") for row in rows], SCHEMA)


def made_rows():
    texts = ["The red fox. The red  fox runs, the RED\tfox;", "a a a a a a! a a a", "été à la été à la", "", None, " \t ",
             "x" * 5000 + " y", "one two three four five", "漢字 漢字 漢字 été", "tail\x0btail\ntail\rtail tail",
             "nul \x00 nul \x1c end", "The red fox. The red  fox runs, the RED\tfox;"]
    langs = ["en", "fr", None, "und"]
    return [(k % 30, texts[(k * k + k // 7) % len(texts)], langs[(k // 3) % 4]) for k in range(160)] + [
        (None, "one two three four five six", "en")] * 3


@pytest.mark.parametrize("sample", [0.0, 0.05, 0.25, 1.0])
def test_equals_brute_force_whatever_the_sample(spark, sample):
    rows = made_rows()
    for least, top in ((2, 2000), (6, 3)):
        mine = mining.collocations(frame(spark, rows), least, top=top, sample=sample)
        assert sorted(map(tuple, mine.collect())) == brute(rows, least, top=top)


def test_blocks_and_held_phrases_do_not_change_counts(spark, monkeypatch):
    rows = made_rows()
    texts = mining._texts(frame(spark, rows).coalesce(1), "text", "lang")
    whole = sorted(map(tuple, mining.count_hashes(texts, (1, 2, 3, 4)).collect()))
    batches = texts.toArrow().to_batches()
    monkeypatch.setattr(mining, "BLOCK_BYTES", 40)
    blocks = list(mining._blocks(iter(batches)))
    counts = Counter()
    for block, langs in blocks:
        words = mining.Block(block, langs)
        for k, hashes in enumerate(words.hashes(), 1):
            counts.update(hashes[words.whole(k)].astype("int64").tolist())
    assert len(blocks) > 50 and sorted(counts.items()) == whole


def test_bitmap_marks_each_key(spark):
    keys = [0, 1, 2**20 - 1, 2**20, -1, -(2**63), 123456789]
    bits = mining.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), 20)
    marked = {8 * i + b for i, byte in enumerate(bits) for b in range(8) if byte >> b & 1}
    assert marked == {k % 2**20 for k in keys}


def test_border_failures_are_counted(spark):
    """A phrase that the sample has never seen comes from expansion passes alone."""
    rows = [(k, "never seen here before", "en") for k in range(8)]
    found = mining.frequent_phrases(frame(spark, rows), 8, sample=0.0)
    assert {(r.words, r.phrase, r.n) for r in found.collect()} >= {(4, "never seen here before", 8), (0, None, 32)}


def test_empty_table(spark):
    assert mining.collocations(frame(spark, [])).collect() == []

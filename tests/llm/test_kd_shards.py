import random
import zlib

import pytest

from emberlog.llm.kd_shards import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, size string, shard int"


def table(spark, hot):
    rng = random.Random(1)
    rows = []
    for k in range(1500):
        source = f"s{rng.randrange(9)}" if rng.random() > 0.3 else "s0"
        text = "x" * 150 if hot and k % 3 == 0 else "é" * rng.choice([0, 5, 40, 300]) + str(rng.randrange(600))
        rows.append((k, text, rng.choice(["en", "de", None]), source, "", 0))
    rows += [(5000, None, None, None, "", 0), (5001, "", "en", "s1", "", 0), (7, "twice", "en", "s1", "", 0),
             (7, "twice", "en", "s1", "", 0), (None, "no id", "en", None, "", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize(("hot", "shards"), [(False, 16), (True, 16), (False, 5)])
def test_shards_are_even_and_slots_gapless(spark, hot, shards):
    rows, docs = table(spark, hot)
    found = kd_shards(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted(
        (i or -1, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total = sum(r.size for r in found)
    for shard in range(shards):
        own = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.doc_id or -1 for r in own] == sorted(r.doc_id or -1 for r in own)
        assert abs(sum(r.size for r in own) / (total / shards) - 1) < 0.1
    homes, weights = {}, {}
    for r in found:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
        weights[r.text_crc32] = weights.get(r.text_crc32, 0) + r.size
    assert all(len(v) == 1 for k, v in homes.items() if weights[k] <= 0.1 * total / shards)
    assert any(len(v) > 1 for v in homes.values()) or not hot


def test_rows_targets_and_empty(spark):
    _, docs = table(spark, False)
    counts = [r["count"] for r in kd_shards(docs, 8, by="rows").groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) < 0.2 * max(counts)
    assert kd_shards(docs, target_bytes=50_000).select("shard").distinct().count() == -(-sum(
        r.size for r in kd_shards(docs).collect()) // 50_000)
    assert kd_shards(docs.limit(0)).count() == 0
    one = kd_shards(docs.filter("doc_id = 5000")).first()
    assert (one.size, one.text_crc32, one.slot) == (1, 0, 0)


def test_native(spark):
    _, docs = table(spark, False)
    assert "Python" not in kd_shards(docs)._jdf.queryExecution().toString()

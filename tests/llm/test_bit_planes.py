import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import bit_planes

TEXTS = [(5, "one  two\n\n three's"), (3, ""), (None, "no id"), (9, None), (3, "again"), (7, "é ü 漢字  <|endoftext|> x"),
         (4, "long words " * 900), (4, "long words " * 900)]


@pytest.mark.parametrize("layout", ["byte", "bit"])
@pytest.mark.parametrize("block", [7, 4096])
def test_round_trip(spark, tmp_path, layout, block):
    docs = spark.createDataFrame([(i, t, i) for i, t in TEXTS], "doc_id long, text string, part long")
    bit_planes.write_tokens(docs, str(tmp_path / "t"), block_ids=block, layout=layout)
    rows = sorted(bit_planes.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens, ids[-1]) == (at, len(ids), 2)
        at += len(ids)
    mine = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert mine == sorted((i or -1, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS)


def test_planes_reverse():
    ids = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint32).astype("<u4").tobytes()
    for layout in ("byte", "bit"):
        assert zlib.crc32(bit_planes.from_planes(bit_planes.to_planes(ids, layout), 1001, layout)) == zlib.crc32(ids)


def test_empty_table(spark, tmp_path):
    bit_planes.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert bit_planes.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_ids_are_not_shuffled_to_the_parts(spark, tmp_path):
    """Where a part begins is broadcast whatever the planner thinks of sizes: only cut documents' ids are shuffled."""
    docs = spark.createDataFrame([(i, t) for i, t in TEXTS], "doc_id long, text string")
    bit_planes.write_tokens(docs, str(tmp_path / "t"), block_ids=7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bit_planes.read_tokens(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

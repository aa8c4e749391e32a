"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_leaks
from test_occurrence_join import brute as brute_groups
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm.common import DROP_SHUFFLES, written

WORDS = {"en": "the of and to in that with this house water thing clean river stone", "de": "der die und das nicht ein mit haus"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, similarity double, copies int"


def corpus():
    rng = random.Random(11)
    items = [(k, " ".join(rng.choices([f"item{n}" for n in range(90)], k=20))) for k in range(6)]
    rows = []
    for k in range(160):
        lang = "en" if k % 4 else "de"
        words = rng.choices(WORDS[lang].split(), k=rng.randint(20, 60)) + [f"u{k}x{n}" for n in range(12)]
        if k % 10 == 3 and rows:
            words = rng.choice(rows)[1].split()
            words[rng.randrange(len(words))] = "changed"
        if k % 16 == 5:
            words[5:5] = rng.choice(items)[1].split()
        if k % 13 == 6:
            words += ["moron", "clown"]
        rows.append((k, " ".join(words), lang, "s", 0, 0.5, 9))
    rows += [(900, None, "en", "s", 0, 0.0, 0), (901, "123 456", "en", "s", 0, 0.0, 0), (902, "", None, None, None, None, None)]
    labels = [(r[0], 1, int("moron" in (r[1] or ""))) for r in rows[:120]]
    return rows, items, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, labels = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs
        assert name == "token_output" or docs.columns == columns
    texts = dict((r[0], r[1]) for r in rows)
    kept = {n: sorted(r.doc_id for r in seen[n].select("doc_id").collect()) for n in list(seen)[:-1]}
    assert kept["language_id"] == sorted(i for i, t in texts.items() if any(c.isalpha() for c in t or ""))
    left = [(i, texts[i]) for i in kept["language_id"]]
    assert kept["ngram_jaccard_join"] == [i for i, _, c in brute_groups(left, 5, 80) if i == c] != kept["language_id"]
    left = [(i, texts[i]) for i in kept["ngram_jaccard_join"]]
    leaks = {i for i, _ in brute_leaks(left, items)}
    assert kept["decontamination"] == [i for i, _ in left if i not in leaks] and leaks
    mixed = [i for i in kept["mixing"] if "moron" in texts[i].split()]
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert len(mixed) <= 0.3 * sum("moron" in texts[i].split() for i in kept["decontamination"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    tokens = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in tokens] == kept["mixing"]
    for r in tokens:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run_is_all_stages(spark):
    folder = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, folder)
    starts = Window.orderBy("start")
    gaps = found.withColumn("next", F.lead("start").over(starts)).filter("next <> start + n_tokens").count()
    assert gaps == 0 and 100 < found.count() <= 300


def test_language_stage_follows_the_prediction(spark, monkeypatch):
    rows, _, _ = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(corpus_pipeline, "WANTED", {"de"})
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, table, "").collect()}
    assert set(kept.values()) == {"de"} and len(kept) == sum(r[2] == "de" for r in rows)


def test_written_tables_leave_no_shuffle_files(spark):
    """A table's own shuffles go as it is written, those of others stay, and the session's setting is as before."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
        if f.getName().endswith(".data")}
    other = spark.range(1000).groupBy((F.col("id") % 9).alias("k")).count()
    other.collect()
    before = files()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    deadline = time.time() + 20  # files go in the background
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert sum(r["count"] for r in table.collect()) == 1000 == sum(r["count"] for r in other.collect())
    assert spark.conf.get(DROP_SHUFFLES, None) is None

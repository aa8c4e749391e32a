import gc
import random
import zlib

import pyarrow as pa
from emberlog.llm.common import arrow_map, once
from emberlog.llm.language_id import Predictor, decisions, fit, identify_languages, keep_identified
from pyspark.sql import functions as F

WORDS = {"en": "the of and to in that with this house water thing",
         "de": "der die und das nicht ein mit haus wasser über straße ding",
         "fr": "le la les des que avec dans maison être très chose eau",
         "es": "el los una que para con casa agua más señor cosa año"}


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((k, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(3, 60))), lang, "x", 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "en", "", 0), (1001, "", "de", "", 0), (1002, "12 34 !!  ", "fr", "", 0),
           (1003, "the water and the thing " * 20_000, None, "", 0), (None, "the of and", "es", "", 0),
           (5, rows[5][1], rows[5][2], "", 0)]
    table = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    found = identify_languages(table).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    truth = {r[0]: r[2] for r in rows}
    outs = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in outs) >= 0.97 * len(outs) > 100
    assert [by_id[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in found)
    kept = keep_identified(table)
    assert kept.columns == table.columns
    assert kept.count() == len(rows) + len(odd) - 3


def test_never_learns_from_held_out_or_own_labels(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    spoiled = table.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert fit(spoiled)[0] == fit(table)[0]
    a = sorted(map(tuple, identify_languages(table).collect()))
    assert a == sorted(map(tuple, identify_languages(spoiled).collect()))


def test_nothing_or_one_language(spark):
    table = spark.createDataFrame([(1, "hello there", None, "", 0)], SCHEMA)
    assert identify_languages(table).first().lang_pred == "und"
    assert identify_languages(table.limit(0)).count() == 0
    one = spark.createDataFrame([(k, "hello there", "en", "", 0) for k in range(8)], SCHEMA)
    assert {r.lang_pred for r in identify_languages(one).collect()} == {"en"}
    assert Predictor(["xx"], [])(None, None) == ("xx", 1.0)


def test_unwanted_and_unsure_languages_go(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in identify_languages(table).collect()}
    kept = {r.doc_id for r in keep_identified(table, min_score=0.6, wanted={"en", "de"}).collect()}
    assert kept == {k for k, r in found.items() if r.lang_pred in ("en", "de") and r.score >= 0.6}
    assert 0 < len(kept) < sum(r[2] in ("en", "de") for r in rows) + 10


def test_a_stage_drops_what_stages_before_it_kept_in_the_workers(spark):
    rows = spark.range(0, 64, 1, 8)

    def held():
        return sum(isinstance(x, Predictor) for x in gc.get_objects())

    def keeps():
        once(Predictor, (), ())
        return lambda batches: [(held(),) for _ in batches]

    def asks_nothing():
        return lambda batches: [(held(),) for _ in batches]

    kept = arrow_map(rows, keeps, "held int")
    assert {r.held for r in kept.collect()} == {1}
    assert {r.held for r in arrow_map(rows, asks_nothing, "held int").collect()} == {0}
    kept.collect()
    texts = spark.createDataFrame(corpus(), SCHEMA).repartition(8)
    assert keep_identified(texts).count() == len(corpus())
    assert {r.held for r in arrow_map(rows, asks_nothing, "held int").collect()} == {0}


def test_features_of_a_batch_are_not_held_together():
    class Features:
        alive = most = 0

        def __init__(self, text):
            self.text = text
            Features.alive += 1
            Features.most = max(Features.most, Features.alive)

        def __del__(self):
            Features.alive -= 1

    texts = pa.array([None, "", *(f"t{k}" for k in range(500))])
    assert list(decisions(texts, Features, lambda f: f.text != "t7")) == [False, False] + [k != 7 for k in range(500)]
    assert Features.most <= 2 and not any(decisions(texts, None, bool))

import math
import random
import re

from emberlog.llm.decontaminate import WIDTH, block_values, contaminated, drop_contaminated, simhash
from pyspark.sql import functions as F


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    return {tuple(w[k:k + WIDTH]) for k in range(len(w) - WIDTH + 1)}


def brute(docs, items):
    """Best weighted Jaccard over all windows of the items' sizes, without any filter."""
    items = [(i, words(t)) for i, t in items if len(words(t)) >= WIDTH]
    frequency = {}
    for _, w in items:
        for s in shingles(w):
            frequency[s] = frequency.get(s, 0) + 1
    weight = lambda s: math.log1p(len(items) / frequency.get(s, 1))
    best = {}
    for d, text in docs:
        w = words(text)
        for i, x in items:
            mine = shingles(x)
            for a in range(-len(x) + 1, len(w)):
                other = shingles(w[max(a, 0):max(a + len(x), 0)])
                if mine & other:
                    both = sum(map(weight, mine & other))
                    similarity = round(both / sum(map(weight, mine | other)), 9)
                    if similarity >= 0.8:
                        best[d, i] = max(best.get((d, i), 0), similarity)
    return best


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "漢字"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(15, 50)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "too short"), (53, items[0][1] + " and a longer end")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 200)))
        if k % 3 == 0:
            copied = rng.choice(items[:12])[1].split()
            if k % 2:
                copied[rng.randrange(len(copied))] = "edited"
            text = f"{text[:80]} {' '.join(copied).upper()}. {text[80:]}"
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[4][1]), (103, items[5][1][:60]), (None, items[6][1]),
             (104, "x " * 40_000 + items[7][1])]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, words string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    found = contaminated(table, bench)
    mine = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    expected = {k: v for k, v in brute(docs, items).items()}
    assert sorted(mine, key=str) == sorted(expected, key=str) and len(mine) > 15
    assert all(abs(mine[k] - expected[k]) < 1e-6 for k in mine)
    kept = drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(
        d for d, _ in docs if d not in {k for k, _ in expected})
    assert contaminated(table.limit(0), bench).count() == 0 and contaminated(table, bench.limit(0)).count() == 0
    assert "Python" not in found._jdf.queryExecution().toString()


def test_multi_index_covers_the_radius(spark):
    rng = random.Random(8)
    rows = []
    for n in range(200):
        a, flips = rng.getrandbits(63), rng.sample(range(63), rng.randint(0, 15))
        rows.append((n, a, a ^ sum(1 << f for f in flips)))
    table = spark.createDataFrame(rows, "n long, a long, b long")
    left = table.select("n", F.explode(block_values("a", 8, 0)).alias("p"))
    right = table.select("n", F.explode(block_values("b", 8, 1)).alias("p"))
    assert left.join(right, ["n", "p"]).select("n").distinct().count() == 200


def test_simhash_votes(spark):
    row = spark.sql("SELECT array('a','b','c') AS w, xxhash64('a') AS x, xxhash64('b') AS y, xxhash64('c') AS z")
    r = row.select(simhash("w").alias("f"), "x", "y", "z").first()
    assert r.f == (r.x & r.y) | (r.x & r.z) | (r.y & r.z)


def test_rows_of_one_id_are_dropped_by_their_own_text(spark):
    item = " ".join(f"w{n}" for n in range(20))
    clean = " ".join(f"c{n}" for n in range(20))
    rows = [(None, item), (None, clean), (4, clean), (4, "x " + item), (5, item), (6, None)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, copy string")
    kept = drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, clean), (4, clean), (6, None)], key=str)


def test_short_and_unspaced_items(spark):
    items = spark.createDataFrame([(1, "Quiet rivers carry Stones"), (2, "yes, maybe"), (3, "\u6771\u4eac\u306e\u5929\u6c17\u306f\u3069\u3046\u3067\u3059\u304b"),
                                   (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "they say quiet rivers carry stones, and so on"), (11, "quiet rivers never carry stones"), (12, "Yes - maybe!"),
        (13, "well yes maybe later"), (14, "\u660e\u65e5\u306e\u6771\u4eac\u306e\u5929\u6c17\u306f\u3069\u3046\u3067\u3059\u304b\u3068\u805e\u304f"),
        (15, "\u6771\u4eac\u3067\u4f1a\u3044\u307e\u3057\u3087\u3046"), (16, None), (17, "..."),
        (18, "quiet rivers carry stones; quiet rivers carry stones")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in contaminated(docs, items).collect()}
    assert found == {(10, 1): (2, 4, 1.0), (12, 2): (0, 2, 1.0), (14, 3): (3, 11, 1.0), (18, 1): (0, 4, 1.0)}
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [11, 13, 15, 16, 17]


def test_simhash_of_any_column_name(spark):
    words = ["one", "two", "three"]
    row = spark.createDataFrame([(words, words, words)], "b array<string>, n array<string>, words array<string>").select(
        simhash("b").alias("x"), simhash("n").alias("y"), simhash("words").alias("z")).first()
    assert row.x == row.y == row.z

"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

1. Words are runs of letters and digits, lower-cased; in scripts without blanks each letter is a word. Wherever a
   document repeats a five-word shingle of an item, the item is laid over the document: that gives a window of the
   item's size. Windows without any common shingle can't reach the wanted similarity, so none is lost by this step.
2. A window's words vote on a 64-bit SimHash. Multi-index Hamming search: fingerprints are cut into blocks; two within
   the radius differ by at most ``radius // blocks`` bits in some block, so items are indexed under every block value
   within that reach, and an equi-join on (block, value) finds every pair within the radius. Similar windows beyond
   the radius are lost: about one in a hundred of those that an edit brings down to 0.8, no whole copy.
3. Pairs are verified by exact weighted Jaccard similarity of their shingles; a shingle weighs the more the fewer items
   have it.

Items under five words are one shingle as a whole. Those of four words are found wherever a document has just these
words in a row; shorter ones, which common prose holds by chance, where they are all of its words.

Equal windows, such as a passage copied a million times, are fingerprinted and verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 15, 8
#: Rows of the items' shingles up to which they go to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Items of this many words, fewer than a shingle has, are looked for inside documents; shorter ones as whole texts.
LEAST_RUN = 4
#: Scripts written without blanks between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def words_of(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, single letters in scripts without blanks; empty for null."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"({UNSPACED})", " $1 ")
    cut = F.split(F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(cut, lambda w: w != "")


def shingle_at(words: str, place: str) -> Column:
    """Hash of the ``WIDTH`` words from ``place`` (0 for the first) on."""
    return F.expr(f"xxhash64({', '.join(f'get({words}, {place} + {k})' for k in range(WIDTH))})")


def shingles_of(words: str) -> Column:
    """Distinct shingle hashes of a list of ``WIDTH`` words at least."""
    return F.expr(f"""array_distinct(transform(sequence(0, size({words}) - {WIDTH}),
        i -> xxhash64({', '.join(f'get({words}, i + {k})' for k in range(WIDTH))})))""")


def simhash(words: str) -> Column:
    """64-bit SimHash: a bit is set if more than half of the words' hashes have it."""
    return F.expr(f"""aggregate(
        transform(sequence(0, 63), _bit -> aggregate({words}, 0,
            (_n, _word) -> _n + cast(shiftright(xxhash64(_word), _bit) & 1 AS int))),
        struct(0L AS bits, 0 AS place),
        (_f, _n) -> struct(_f.bits | if(2 * _n > size({words}), shiftleft(1L, _f.place), 0L) AS bits,
                           _f.place + 1 AS place),
        _f -> _f.bits)""")


def block_values(fingerprint: str, blocks: int, reach: int) -> Column:
    """(block, value) pairs of a fingerprint: its own values, and those one bit away if ``reach`` is 1."""
    bits = 64 // blocks
    flips = f"concat(array(0L), transform(sequence(0, {bits - 1}), x -> shiftleft(1L, x)))" if reach else "array(0L)"
    return F.expr(f"""flatten(transform(sequence(0, {blocks - 1}), k -> transform({flips}, flip ->
        struct(k AS block, (shiftright({fingerprint}, k * {bits}) & {(1 << bits) - 1}L) ^ flip AS value))))""")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
                 blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of each document for each item.

    Null and empty texts and items, and items without a word, give nothing. Items of fewer than five words must be
    repeated exactly: those of four words anywhere in a text, shorter ones as all of it. Rows that share an id are
    looked at apart and reported under it together. Ties go to the earliest window. Empty tables give an empty one.
    """
    best = F.max_by(F.struct("first_word", "n_words", "distance", "similarity"),
                    F.struct("similarity", -F.col("first_word"), -F.col("n_words")))
    found = matching_windows(docs, items, similarity, radius, blocks, id_col, text_col, item_col, item_text)
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def matching_windows(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
                     blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, copy, item_id, first_word, n_words, distance, similarity): every window that repeats an item; ``copy``
    is the hash of its text and tells rows of one id apart."""
    if 64 % blocks or radius // blocks > 1:
        raise ValueError("blocks must divide 64 and the radius be less than twice their number")
    every = written(items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("item_words"))
                    .filter(F.size("item_words") > 0), "items")
    known = every.filter(F.size("item_words") >= WIDTH).withColumn("item_shingles", shingles_of("item_words"))
    spread = known.select("item_id", F.size("item_words").alias("n_words"),
                          F.posexplode(F.expr(f"transform(sequence(0, size(item_words) - {WIDTH}), i -> i)")).alias(
                              "offset", "at"), "item_words").select(
        "n_words", "offset", shingle_at("item_words", "at").alias("shingle")).distinct()
    count = known.agg(F.count("*"), F.sum(F.size("item_words"))).first()
    near = F.broadcast if (count[1] or 0) <= BROADCAST_ROWS else (lambda df: df)

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = (text.select("doc_id", F.xxhash64("text").alias("copy"), words_of(F.col("text")).alias("words"))
              .select("doc_id", "copy", "words", F.posexplode("words").alias("place", "word"))
              .filter(F.col("place") <= F.size("words") - WIDTH)
              .withColumn("shingle", shingle_at("words", "place")))
    first = F.greatest(F.col("place") - F.col("offset"), F.lit(0))
    hits = placed.join(near(spread), "shingle").select(
        "doc_id", "copy", first.alias("first_word"), "n_words",
        F.concat_ws(" ", F.expr("slice(words, greatest(place - offset, 0) + 1, n_words + least(place - offset, 0))")
                    ).alias("content"))
    windows = written(hits.groupBy("doc_id", "copy", "first_word", "n_words").agg(
        F.first("content").alias("content")).withColumn("window", F.md5(F.concat_ws(" ", "n_words", "content"))), "windows")

    contents = windows.groupBy("window").agg(
        F.first("n_words").alias("n_words"), F.first("content").alias("content")).select(
        "window", "n_words", F.split("content", " ").alias("words")).filter(F.size("words") >= WIDTH)
    contents = written(contents.select("window", "n_words", simhash("words").alias("fingerprint"),
                                       shingles_of("words").alias("shingles")), "fingerprints")
    marked = known.select("item_id", F.size("item_words").alias("n_words"),
                          simhash("item_words").alias("item_fingerprint"))
    reach = radius // blocks
    probes = contents.select("n_words", "fingerprint").distinct().select(
        "n_words", "fingerprint", F.explode(block_values("fingerprint", blocks, 0)).alias("probe"))
    index = marked.select("n_words", "item_id", "item_fingerprint",
                          F.explode(block_values("item_fingerprint", blocks, reach)).alias("probe"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))).cast("int")
    within = probes.join(index, ["n_words", "probe"]).filter(distance <= radius).select(
        "n_words", "fingerprint", "item_id", distance.alias("distance")).distinct()

    total = float(count[0] or 0)
    frequency = known.select(F.explode("item_shingles").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("n_items"))
    weight = F.log1p(F.lit(total) / F.coalesce(F.col("n_items"), F.lit(1)))
    weighed = contents.select("window", F.explode("shingles").alias("shingle")).join(frequency, "shingle", "left")
    of_window = weighed.groupBy("window").agg(F.sum(weight).alias("window_weight"))
    of_item = known.select("item_id", F.explode("item_shingles").alias("shingle")).join(frequency, "shingle").select(
        "item_id", "shingle", weight.alias("weight"))
    item_total = of_item.groupBy("item_id").agg(
        F.sum("weight").alias("item_weight"), F.collect_list(F.struct("shingle", "weight")).alias("parts"))
    common = F.expr("aggregate(parts, 0D, (s, p) -> s + if(array_contains(shingles, p.shingle), p.weight, 0D))")
    pairs = (contents.join(within, ["n_words", "fingerprint"]).join(item_total, "item_id").join(of_window, "window")
             .withColumn("common", common)
             .withColumn("similarity", F.col("common") / (F.col("item_weight") + F.col("window_weight") - F.col("common")))
             .filter(F.round("similarity", 9) >= similarity)
             .select("window", "item_id", "distance", F.round("similarity", 9).alias("similarity")))
    found = windows.join(pairs, "window").select(
        "doc_id", "copy", "item_id", "first_word", "n_words", "distance", "similarity")
    short = every.filter(F.size("item_words") < WIDTH)
    return found if short.isEmpty() else found.unionByName(short_windows(text, short))


def short_windows(text: DataFrame, short: DataFrame) -> DataFrame:
    """Windows equal to items shorter than a shingle: runs of ``LEAST_RUN`` words, and whole texts of fewer."""
    words = text.select("doc_id", F.xxhash64("text").alias("copy"), words_of(F.col("text")).alias("words"))
    runs = words.filter(F.size("words") >= LEAST_RUN).select(
        "doc_id", "copy", F.posexplode(F.expr(f"""transform(sequence(0, size(words) - {LEAST_RUN}),
            _at -> concat_ws(' ', slice(words, _at + 1, {LEAST_RUN})))""")).alias("first_word", "content"))
    whole = words.filter(F.size("words").between(1, LEAST_RUN - 1)).select(
        "doc_id", "copy", F.lit(0).alias("first_word"), F.concat_ws(" ", "words").alias("content"))
    wanted = short.select("item_id", F.size("item_words").alias("n_words"), F.concat_ws(" ", "item_words").alias("content"))
    return runs.unionByName(whole).join(wanted, "content").select(
        "doc_id", "copy", "item_id", "first_word", "n_words", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that repeat no item. Each row is judged by its own text, whatever rows share its id, and
    whether it has one."""
    found = matching_windows(docs, items, **options).select(
        F.col("doc_id").alias("_found"), F.col("copy").alias("_copy")).distinct()
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    return docs.join(found, docs[id_col].eqNullSafe(found["_found"]) & (F.xxhash64(docs[text_col]) == found["_copy"]),
                     "left_anti")

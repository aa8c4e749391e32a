"""Phrase collocations by Toivonen's sampling.

A sample of the documents proposes phrases. A full pass counts the proposed ones and their negative border: every
phrase that was not proposed though both of its parts one word shorter were. A border phrase that turns out frequent
breaks the proposal; it joins, and an expansion pass counts the border that it opens, and the border of that border, as
far as phrases go. As each part of a frequent phrase is frequent, either is proposed or lies on a border counted so
far, or failed and joined: one expansion closes the set, and all frequent phrases are known.

Passes count 64-bit hashes of phrases: a collision can only add a false candidate, never lose one. The proposal goes to
the tasks as a bitmap of bounded size; with more phrases than it can tell apart, tasks count more than the border, never
less. A last pass counts the words themselves and decides. Inside a task words are spans of bytes and phrases numbers,
so whole blocks of texts are handled at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.session import ship_package

from .common import release_memory, written

#: Words of the longest phrase.
LONGEST = 4
#: Share of the documents in the sample, and of the threshold that makes a phrase frequent in it.
SAMPLE, LOWERED = 0.1, 0.67
#: Bits of a proposal's bitmap: 16 a phrase, between these powers of two (128 KB to 32 MB).
LEAST_BITS, MOST_BITS = 20, 28
#: Bytes of text that a task handles at once, and distinct phrases that it holds, as hashes and spelled, before it
#: hands them on.
BLOCK_BYTES, HELD, SPELLED = 1_500_000, 2_000_000, 1_000_000
COUNTED, NAMED = "key long, n long", "lang string, words int, phrase string, n long"
#: Piece ends become line feeds, tabs become blanks, A-Z become a-z.
FOLD = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")
_UNKNOWN = "und"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Weights:
    """Random odd 64-bit weights of the places in a word, grown on demand; the same in every task."""

    def __init__(self, seed: int):
        self.seed, self.values = seed, np.zeros(0, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            places = np.arange(max(n, 64, 2 * len(self.values)), dtype=np.uint64) + np.uint64(1)
            self.values = _mixed(places * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed)) | np.uint64(1)
        return self.values


class Block:
    """The words of some texts as spans of one buffer, with hashes of the phrases that begin at each word."""

    weights, checks = Weights(1), Weights(2)

    def __init__(self, texts: list[tuple[int, bytes]], langs: list[str]):
        self.langs = langs
        data = b"\n".join([*(text for _, text in texts), b""])
        self.data, self.bytes = data, np.frombuffer(data, np.uint8)
        inside = self.bytes != 32
        inside &= self.bytes != 10
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        lines = np.cumsum(self.bytes == 10, dtype=np.int32)
        self.piece = lines[self.starts]
        del lines
        sizes = np.array([len(text) + 1 for _, text in texts])
        owner = np.searchsorted(np.cumsum(sizes), self.starts, side="right")
        self.lang = np.array([lang for lang, _ in texts], np.int64)[owner]
        self.inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def spelled(self, weights: Weights) -> np.ndarray:
        """A hash of each word's bytes: a sum of (byte + 1) by the weight of its place."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(firsts.astype(np.int32), lengths)
        terms = weights.first(int(lengths.max()))[place]
        terms *= self.bytes[self.inside].astype(np.uint64) + np.uint64(1)
        return np.add.reduceat(terms, firsts)

    def hashes(self, weights: Weights | None = None) -> list[np.ndarray]:
        """By words of a phrase from 1 on: the hash of the phrase of the word's language that begins at each word."""
        tongue = np.array([int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")
                           for lang in self.langs], np.uint64)
        word = _mixed(self.spelled(weights or self.weights) + _mixed(tongue)[self.lang])
        found = [word]
        for size in range(2, LONGEST + 1):
            found.append(_mixed(found[-1][:len(word) - size + 1] * np.uint64(0x9FB21C651E98DF25)
                                + word[size - 1:] * np.uint64(0xD6E8FEB86659FD93)) if len(word) >= size
                         else word[:0])
        return found

    def whole(self, size: int) -> np.ndarray:
        """Whether the phrase of ``size`` words that begins at a word lies in one piece."""
        n = max(len(self) - size + 1, 0)
        return self.piece[:n] == self.piece[len(self) - n:]


class Proposal:
    """Hashes as bits of a bitmap: no proposed one is missed, a few others may seem proposed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def on_border(hashes: list[np.ndarray], whole: Callable[[int], np.ndarray], proposal: Proposal | None,
              known: int) -> list[np.ndarray]:
    """By words of a phrase: whether both parts one word shorter are proposed; above ``known`` + 1 words, where no
    parts are proposed yet, whether they may still come to be."""
    may = [np.ones(len(hashes[0]), bool)]
    for size in range(2, LONGEST + 1):
        here = whole(size)
        if proposal is not None:
            parts = proposal.holds(hashes[size - 2]) if size - 1 <= known else may[-1]
            here &= parts[:len(here)] & parts[1:len(here) + 1]
        may.append(here)
    return may


def opened(hashes: list[np.ndarray], whole: Callable[[int], np.ndarray], proposal: Proposal,
           counted: Proposal) -> list[np.ndarray]:
    """By words of a phrase: whether it was not on the border of ``counted``, and each of its parts is proposed or in
    turn is such a phrase."""
    fresh = [np.zeros(len(hashes[0]), bool)]
    for size, before in zip(range(2, LONGEST + 1), on_border(hashes, whole, counted, LONGEST)[1:], strict=True):
        parts = proposal.holds(hashes[size - 2])
        parts |= fresh[-1]
        here = whole(size)
        here &= parts[:len(here)] & parts[1:len(here) + 1] & ~before
        fresh.append(here)
    return fresh


def bitmap(keys: DataFrame, power: int) -> bytes:
    """One bit for each hash of ``keys``, at most 2 ** ``power`` bits: built in the cluster, put together here."""
    at = F.expr(f"(key & {(1 << power) - 1}) + 1")
    parts = (keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    out = bytearray(1 << power - 3)
    for row in parts.toLocalIterator():
        out[(row.part - 1) * 4096:(row.part - 1) * 4096 + 4096] = row.bits
    return bytes(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes]], list[str]]]:
    """Texts and their languages in blocks of bounded size; a long text is cut between two pieces."""
    langs: dict[str, int] = {}
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = (text.as_py() or b"").translate(FOLD)
            code = langs.setdefault(lang, len(langs))
            while text:
                cut = text.rfind(b"\n", 0, BLOCK_BYTES) if len(text) > BLOCK_BYTES else -1
                if cut < 0 and len(text) > BLOCK_BYTES:
                    cut = text.find(b"\n", BLOCK_BYTES)
                part, text = (text, b"") if cut < 0 else (text[:cut], text[cut + 1:])
                held.append((code, part))
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield held, list(langs)
                    held, size = [], 0
    if held:
        yield held, list(langs)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_UNKNOWN)).alias("lang"),
                       F.col(text_col).cast("string").cast("binary").alias("text"))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(counts[order], firsts) if len(keys) else counts


def count_hashes(texts: DataFrame, sizes: tuple[int, ...], proposal=None, counted=None,
                 known: int = LONGEST) -> DataFrame:
    """(key, n) of the phrases of ``sizes`` words that are proposed or on the border of ``proposal`` (a broadcast
    bitmap; none: all phrases); with ``counted``, of those that the proposal opens beyond that border."""
    ship_package(texts.sparkSession)

    def run(batches):
        new = None if proposal is None else Proposal(np.frombuffer(proposal.value, np.uint8))
        old = None if counted is None else Proposal(np.frombuffer(counted.value, np.uint8))
        held, size = [], 0

        def out():
            keys, counts = _merged(held)
            for at in range(0, len(keys), 65_536):
                part = keys[at:at + 65_536].view(np.int64), counts[at:at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], names=["key", "n"])

        for block, langs in _blocks(batches):
            words = Block(block, langs)
            hashes = words.hashes()
            chosen = (on_border(hashes, words.whole, new, known) if old is None
                      else opened(hashes, words.whole, new, old))
            for k in sizes:
                keys, counts = np.unique(hashes[k - 1][chosen[k - 1]], return_counts=True)
                held.append((keys, counts.astype(np.int64)))
                size += len(keys)
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
        held = []
        release_memory()

    # A task hands on each key about once, so the engine's own partial sums would only cost.
    return texts.mapInArrow(run, COUNTED).repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


class Spelled:
    """Phrases that a task has met: sorted hashes, a second hash of each, and its language, size and bytes."""

    def __init__(self):
        self.keys = self.marks = np.zeros(0, np.uint64)
        self.rows = self.ends = np.zeros(0, np.int64)
        self.langs, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.data = bytearray()

    def __len__(self) -> int:
        return len(self.keys)

    def meet(self, words: Block, size: int, keys: np.ndarray, marks: np.ndarray, begins: np.ndarray) -> None:
        """Take in the phrases of ``size`` words with these sorted hashes that begin at these words."""
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        there[inside] = self.keys[at[inside]] == keys[inside]
        if (self.marks[at[there]] != marks[there]).any():
            raise ValueError("two phrases share a hash: choose other weights")
        at, keys, marks, begins = at[~there], keys[~there], marks[~there], begins[~there]
        text, spans = words.data, [(words.starts[begins + k].tolist(), words.ends[begins + k].tolist()) for k in range(size)]
        parts = [text[a:b] for a, b in zip(*spans[0], strict=True)]
        for span in spans[1:]:
            parts = [part + b" " + text[a:b] for part, a, b in zip(parts, *span, strict=True)]
        ends = len(self.data) + np.cumsum([len(part) for part in parts], dtype=np.int64)
        self.data += b"".join(parts)
        self.rows = np.insert(self.rows, at, len(self.ends) + np.arange(len(parts)))
        self.keys, self.marks = np.insert(self.keys, at, keys), np.insert(self.marks, at, marks)
        self.ends = np.concatenate([self.ends, ends])
        self.langs = np.concatenate([self.langs, words.lang[begins]])
        self.sizes = np.concatenate([self.sizes, np.full(len(parts), size, np.int32)])

    def counted(self, keys: np.ndarray, counts: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows of phrases that were met, by their sorted hashes."""
        offsets = np.concatenate([[0], self.ends])
        tongues, data = pa.array(langs, pa.string()), pa.py_buffer(bytes(self.data))
        phrases = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(offsets), data])
        rows = self.rows[np.searchsorted(self.keys, keys)]
        for a in range(0, len(rows), 65_536):
            part = rows[a:a + 65_536]
            yield pa.RecordBatch.from_arrays(
                [tongues.take(pa.array(self.langs[part])), pa.array(self.sizes[part]),
                 phrases.take(pa.array(part)).cast(pa.binary()).cast(pa.string()), pa.array(counts[a:a + 65_536])],
                names=["lang", "words", "phrase", "n"])


def count_words(texts: DataFrame, frequent) -> DataFrame:
    """(lang, words, phrase, n) of the phrases whose hash is in the bitmap ``frequent``, by the words themselves, and
    of each language the number of its words, with a null phrase. Phrases of a task that share one hash but not a
    second one end it."""
    ship_package(texts.sparkSession)

    def run(batches):
        chosen = Proposal(np.frombuffer(frequent.value, np.uint8))
        met, totals, held, langs = Spelled(), {}, [], []

        def out():
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[lang] for lang in totals], pa.string()), pa.array([0] * len(totals), pa.int32()),
                 pa.nulls(len(totals), pa.string()), pa.array(totals.values(), pa.int64())],
                names=["lang", "words", "phrase", "n"])
            if held:
                yield from met.counted(*_merged(held), langs)

        for block, langs in _blocks(batches):
            words = Block(block, langs)
            for lang, n in zip(*np.unique(words.lang, return_counts=True), strict=True):
                totals[int(lang)] = totals.get(int(lang), 0) + int(n)
            hashes, checks = words.hashes(), words.hashes(words.checks)
            for size in range(1, LONGEST + 1):
                at = np.flatnonzero(words.whole(size) & chosen.holds(hashes[size - 1]))
                order = at[np.argsort(hashes[size - 1][at], kind="stable")]
                keys, marks = hashes[size - 1][order], checks[size - 1][order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                if (marks[1:] != marks[:-1])[~new[1:]].any():
                    raise ValueError("two phrases share a hash: choose other weights")
                firsts = np.flatnonzero(new)
                met.meet(words, size, keys[firsts], marks[firsts], order[firsts])
                held.append((keys[firsts], np.diff(np.append(firsts, len(keys)))))
            if sum(len(keys) for keys, _ in held) > HELD:
                held = [_merged(held)]
            if len(met) > SPELLED:
                yield from out()
                met, totals, held = Spelled(), {}, []
        yield from out()
        met, held = None, []
        release_memory()

    return texts.mapInArrow(run, NAMED).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 30, sample: float = SAMPLE, lowered: float = LOWERED,
                     text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n): every phrase of one to four words with ``least`` or more occurrences in its language,
    counted exactly, and of each language the number of its words (``words`` 0, ``phrase`` null).

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and those at blanks and tabs into words;
    overlapping occurrences count each. Null texts are empty, null languages are ``und``; repeated rows count each;
    languages and tables without words give no rows.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    share = math.ceil(sample * 2 ** 20)
    drawn = texts.filter(F.expr(f"xxhash64(text, lang, monotonically_increasing_id()) & {2 ** 20 - 1} < {share}"))
    drawn = written(drawn, "phrase-sample")
    enough = max(2, math.floor(sample * lowered * least))
    share_bitmap = spark.sparkContext.broadcast

    def often(counts: DataFrame, n: int) -> DataFrame:
        return written(counts.filter(F.col("n") >= n), "phrases")

    short = often(count_hashes(drawn, (1, 2)), enough)
    power = _power(short.count())
    seed = share_bitmap(bitmap(short, power))
    proposed = short.union(often(count_hashes(drawn, (3, 4), seed, known=2), enough)).select("key")
    power = _power(proposed.count())
    border = share_bitmap(bitmap(proposed, power))
    counts = often(count_hashes(texts, (1, 2, 3, 4), border), least)
    frequent = counts.select("key")
    failed = written(frequent.join(proposed, "key", "left_anti"), "failures")
    if failed.take(1):
        both = np.frombuffer(border.value, np.uint8) | np.frombuffer(bitmap(failed, power), np.uint8)
        frequent = frequent.union(often(count_hashes(texts, (2, 3, 4), share_bitmap(both.tobytes()), border), least)
                                  .select("key"))
    power = _power(frequent.count())
    return count_words(texts, share_bitmap(bitmap(frequent, power))).filter(
        (F.col("n") >= least) | F.col("phrase").isNull())


def _power(phrases: int) -> int:
    return min(max(math.ceil(math.log2(16 * max(phrases, 1))), LEAST_BITS), MOST_BITS)


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, sample: float = SAMPLE,
                 lowered: float = LOWERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the lowest score, ``n`` the words of the
    language; the score is floor(2000000 * a / (l + r)). A phrase inside a longer frequent one that has ``covered`` per
    cent of its occurrences is dropped. Ties go to more occurrences, then to the phrase's bytes.
    """
    found = written(frequent_phrases(docs, least, sample, lowered, text_col, lang_col), "frequent")
    totals = found.filter("phrase IS NULL").select("lang", F.col("n").alias("words_of_lang"))
    known = found.filter("phrase IS NOT NULL").select("lang", "phrase", "n")
    longer = found.filter("words >= 2").select("lang", "phrase", F.col("n").alias("a"),
                                               F.split("phrase", " ").alias("w"))
    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"),
        F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr(
        "CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + r)"))
    best = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = longer.filter("size(w) > 2").select("lang", "a", "w", F.explode(
        F.expr("sequence(2, size(w) - 1)")).alias("size")).select("lang", "a", "w", "size", F.explode(
            F.expr("sequence(1, size(w) - size + 1)")).alias("at")).groupBy(
        "lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(
        f"most IS NULL OR CAST(100 AS DECIMAL(3, 0)) * most < CAST({int(covered)} AS DECIMAL(10, 0)) * a")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "best.l", "best.r", F.col("words_of_lang").alias("n"), "best.score")

"""Hierarchical language identification: the family first, then closely related languages within it.

Features are hashed character 1- to 3-grams of the whole text, letters only, words apart. At each level, one-versus-one
linear support vector machines vote. Machines are fitted on a bounded sample of labelled rows, each in a task of its
own; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget_unasked, once, release_memory, rows_of, ship_package, written

#: Language families. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz"), "baltic": ("lt", "lv"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"), "semitic": ("ar", "he", "mt"),
}
UNKNOWN = "und"
#: Labelled rows of each language that the machines are fitted on, about; the bound of the sample.
SAMPLE_PER_LANGUAGE = 500
BITS = 12
SAMPLE = "lang string, features binary"
MACHINES = "level string, a string, b string, weights binary"
PREDICTED = "doc_id long, lang_pred string, score double"


class Grams:
    """Hashed character n-grams: (bins, values of unit length), or nothing for a text without letters."""

    def __init__(self, bits: int):
        self.bits = bits
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[codes]
        if not letter.any():
            return None
        codes = np.where(letter, codes, np.uint32(32))[np.concatenate([[True], letter[1:] | letter[:-1]])]
        codes = codes.astype(np.uint64)
        two = codes[:-1] * np.uint64(0x9E3779B1) + codes[1:]
        three = two[:-1] * np.uint64(0x9E3779B1) + codes[2:]
        grams = np.concatenate([codes, two, three]) * np.uint64(0x9E3779B97F4A7C15)
        counts = np.bincount((grams >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        bins = np.flatnonzero(counts)
        values = np.sqrt(counts[bins])
        return bins, values / np.linalg.norm(values)


def fit_machine(vectors: np.ndarray, signs: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss, by dual coordinate descent."""
    x = np.concatenate([vectors, np.ones((len(vectors), 1))], axis=1)
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    slack = 0.5 / (cost * 0.5 / share)  # both classes weigh the same
    square = (x * x).sum(axis=1) + slack
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for k in rng.permutation(len(x)):
            gradient = signs[k] * (x[k] @ weights) - 1 + slack[k] * alpha[k]
            moved = max(alpha[k] - gradient / square[k], 0.0)
            weights += (moved - alpha[k]) * signs[k] * x[k]
            alpha[k] = moved
    return weights


def held_out(id_col: str = "doc_id"):
    """True for rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _family(lang: str) -> str:
    return next((family for family, langs in FAMILIES.items() if lang in langs), lang)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[tuple]]:
    """The learned languages and the machines (level, a, b, weights).

    Learns from rows with text and language that :func:`held_out` doesn't mark. The sample of a language is the rows
    whose id's hash lies under a threshold, one per id.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
                       ).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    chance = counts.select("lang", (F.lit(float(sample_per_language)) / F.col("n")).alias("chance"))
    uniform = (F.xxhash64(F.col("doc_id"), F.lit("sample")).bitwiseAND(0xFFFFFFFF)) / float(2**32)
    sample = (rows.join(F.broadcast(chance), "lang").filter((uniform < F.col("chance")) & F.col("text").isNotNull())
              .select("doc_id", "lang", "text"))

    def make():
        grams = once(Grams, BITS)

        def run(batches) -> Iterator[tuple]:
            for _, lang, text in rows_of(batches, 64):
                found = grams(text)
                if found:
                    yield lang, found[0].astype("<u2").tobytes() + found[1].astype("<f4").tobytes()

        return run

    seen = written(arrow_map(sample.dropDuplicates(["doc_id", "lang"]), make, SAMPLE), "language-sample")
    langs = sorted(r.lang for r in seen.select("lang").distinct().collect())
    families = sorted({_family(lang) for lang in langs})
    tasks = [("family", a, b, lang, sign) for a, b in combinations(families, 2) for lang in langs
             for side, sign in ((a, 1), (b, -1)) if _family(lang) == side]
    tasks += [(_family(a), a, b, lang, sign) for a, b in combinations(langs, 2) if _family(a) == _family(b)
              for lang, sign in ((a, 1), (b, -1))]
    if not tasks:
        return langs, []
    spark = docs.sparkSession
    dealt = spark.createDataFrame(tasks, "level string, a string, b string, lang string, sign int")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(rows), 1 << BITS))
        for k, packed in enumerate(rows["features"]):
            n = len(packed) // 6
            vectors[k, np.frombuffer(packed[:2 * n], "<u2")] = np.frombuffer(packed[2 * n:], "<f4")
        weights = fit_machine(vectors, rows["sign"].to_numpy().astype(float))
        head = rows.iloc[0]
        return pd.DataFrame([(head["level"], head["a"], head["b"], weights.astype("<f8").tobytes())],
                            columns=["level", "a", "b", "weights"])

    machines = seen.join(F.broadcast(dealt), "lang").groupBy("level", "a", "b").applyInPandas(train, MACHINES)
    return langs, sorted(tuple(r) for r in machines.collect())


class Predictor:
    """Votes of the machines, level by level."""

    def __init__(self, langs: list[str], machines: list[tuple]):
        self.langs = langs
        self.levels: dict[str, tuple[list, np.ndarray]] = {}
        for level in {m[0] for m in machines}:
            own = [m for m in machines if m[0] == level]
            self.levels[level] = ([(a, b) for _, a, b, _ in own],
                                  np.stack([np.frombuffer(w, "<f8") for *_, w in own]))

    def vote(self, level: str, bins: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        """The winner of a level, and how sure its least sure machine is."""
        pairs, weights = self.levels[level]
        margins = weights[:, bins] @ values + weights[:, -1]
        sure = {}
        votes: dict[str, float] = {}
        for (a, b), margin in zip(pairs, margins.tolist(), strict=True):
            chance = 1 / (1 + np.exp(-min(max(3 * margin, -30.0), 30.0)))
            for name, p in ((a, chance), (b, 1 - chance)):
                votes[name] = votes.get(name, 0.0) + (p >= 0.5) + 1e-3 * p
                sure[name] = min(sure.get(name, 1.0), p)
        best = min(votes, key=lambda name: (-votes[name], name))
        return best, float(sure[best])

    def __call__(self, bins: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        name, score = self.langs[0], 1.0
        if "family" in self.levels:
            name, score = self.vote("family", bins, values)
        else:
            name = _family(name)
        if name in self.levels:
            name, own = self.vote(name, bins, values)
            return name, score * own
        return next(lang for lang in self.langs if _family(lang) == name), score


def identify(docs: DataFrame, langs: list[str], machines: list[tuple],
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row from its whole text; no shuffle.

    Null texts, texts without a letter, and all texts if nothing was learned, are ``und`` with score 0. The score is
    the product over the levels of the least sure winning vote.
    """
    def make():
        grams, predict = once(Grams, BITS), Predictor(langs, machines)

        def run(batches) -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, 64):
                found = grams(text) if text and langs else None
                yield (doc_id, *(predict(*found) if found else (UNKNOWN, 0.0)))

        return run

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     make, PREDICTED)


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """Fit on ``docs`` and predict all of it: (doc_id, held_out, lang_pred, score)."""
    return identify(docs, *fit(docs, **options)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def decisions(texts: pa.Array, grams, fits) -> Iterator[bool]:
    """Whether each text has features and they fit; one text's features at a time, as a batch has thousands."""
    for at in range(0, len(texts), 64):
        for text in texts.slice(at, 64).to_pylist():
            found = grams(text) if text and grams else None
            yield bool(found) and bool(fits(found))


def keep_identified(docs: DataFrame, min_score: float = 0.0, wanted: Collection[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, neither ``und`` nor below ``min_score``, and is one of
    ``wanted``, if that is given. Same columns."""
    langs, machines = fit(docs)

    def fits(lang: str, score: float) -> bool:
        return score >= min_score and (wanted is None or lang in wanted)

    def make():
        return once(Grams, BITS), Predictor(langs, machines)

    ship_package(docs.sparkSession)

    @F.arrow_udf("boolean")
    def fine(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, predict = make()
        forget_unasked()
        for texts in batches:
            yield pa.array(decisions(texts, grams if langs else None, lambda f: fits(*predict(*f))), pa.bool_())
        texts = None
        release_memory()

    return docs.filter(fine("text"))

"""Exact token counts of every prefix, by dynamic programming.

In byte-pair encoding the last token of an encoded prefix is the only token that ends there and is *compatible* with
the last token before it: the pair encodes to itself. So ``count(i) = count(i - len(last)) + 1`` walks a word once and
knows every prefix on the way. Words are short and repeat; a worker walks each word once. A text's counts are the
counts of its words, with three corrections where a cut changes how the text is divided into words: inside a run of
white space, inside a contraction, and inside a special string.

The counts of a text are stored as compressed differences, one number per code point. Truncation and budget questions
are answered from them without encoding again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_words import ByteWords, Kept
from .common import arrow_map, keyed_text, once, rows_of

COUNTS = "doc_id long, n_chars long, n_bytes long, n_tokens long, prefix_counts binary"
#: Contractions that the word pattern knows, of those with more than one letter.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounts:
    """Counts of all prefixes of texts under one byte-level tokenizer."""

    def __init__(self, name: str):
        self.bpe = ByteWords(name)
        self.tails = {token[k:] for token in self.bpe.vocabulary for k in range(len(token))}
        self.itself = Kept(lambda token: self._values(token) == [token])
        self.fits = Kept(lambda pair: self._values(pair[0] + pair[1]) == [*pair])
        self.steps = Kept(self.steps_of)
        self.totals = Kept(lambda word: self.of_word(word)[-1])

    def _values(self, shown: str) -> list[str]:
        return [piece.value for piece in self.bpe.pieces(shown)]

    def of_word(self, word: str) -> list[int]:
        """Token counts of the word's prefixes by code point."""
        shown = self.bpe.shown(word)
        vocabulary, itself, fits, tails = self.bpe.vocabulary, self.itself, self.fits, self.tails
        last, begin, count = [""], [0], [0]
        for end in range(1, len(shown) + 1):
            start = begin[-1]  # most often the last token grows; only one token can end here, so order is free
            token = shown[start:end]
            if not (token in vocabulary and itself[token] and (not start or fits[last[start], token])):
                for start in range(end - 1, -1, -1):
                    token = shown[start:end]
                    if token in vocabulary:
                        if itself[token] and (not start or fits[last[start], token]):
                            break
                    elif token not in tails:
                        raise ValueError(f"no token ends at byte {end} of {word!r}")
            last.append(token)
            begin.append(start)
            count.append(count[start] + 1)
        if word in LONG_CONTRACTIONS:
            count[2] = 2  # the quote and one letter are two words until the contraction is whole
        if len(shown) == len(word):
            return count[1:]
        ends = accumulate(len(c.encode("utf-8")) for c in word)
        return [count[end] for end in ends]

    def steps_of(self, word: str) -> bytes:
        counts = self.of_word(word)
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def of_segment(self, text: str) -> np.ndarray:
        """Steps of the counts of a text without special strings."""
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, self.bpe.words(text))), np.int16).astype(np.int32)
        for gap in self.bpe.gaps(text):  # cut after a whole run: its last character is not yet the next word's
            run = gap.group()
            apart = self.totals[run[:-1]] + self.totals[run[-1]]
            steps[gap.end() - 1] += self.totals[run] - apart
            steps[gap.end()] -= self.totals[run] - apart
        return steps

    def of_text(self, text: str) -> np.ndarray:
        """Steps (differences) of the counts, one per code point."""
        parts = []
        segments = self.bpe.segments(text)
        for place, segment in enumerate(segments):
            if place % 2 == 0:
                parts.append(self.of_segment(segment) if segment else np.zeros(0, np.int32))
                continue
            before = int(parts[-1].sum())
            plain = segments[place - 1]
            inside = [int(self.of_segment(plain + segment[:k]).sum()) - before for k in range(1, len(segment))]
            parts.append(np.diff([*inside, 1], prepend=0).astype(np.int32))
        for kept in (self.itself, self.fits, self.steps, self.totals):
            kept.trim()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def pack_steps(steps: np.ndarray) -> bytes:
    """Steps as one byte each where they fit, else as four, after a byte that says which."""
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    raw = steps.astype(np.int8 if small else "<i4").tobytes()
    return (b"1" if small else b"4") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_counts(packed: bytes) -> np.ndarray:
    """The counts of all prefixes, from the empty one on."""
    raw = zstandard.ZstdDecompressor().decompress(packed[1:])
    steps = np.frombuffer(raw, np.int8 if packed[:1] == b"1" else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefix_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_tokens, prefix_counts) for every row, whole texts.

    Null and empty texts have 0 tokens and one count, that of the empty prefix. Rows with equal ids stay apart; an
    empty table gives an empty one. No shuffle: rows don't meet.
    """

    def make():
        counter = once(PrefixCounts, tokenizer)

        def run(batches) -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, 64):
                text = text or ""
                steps = counter.of_text(text)
                yield doc_id, len(text), len(text.encode("utf-8")), int(steps.sum()), pack_steps(steps)

        return run

    return arrow_map(keyed_text(docs, id_col, text_col), make, COUNTS)


def tokens_of_prefix(counts: Column | str, n_chars: Column | str) -> Column:
    """Tokens of the first ``n_chars`` code points; past the end, of the whole text."""
    @F.pandas_udf("long")
    def ask(packed, n):
        values = [None if p is None or k != k else int((c := unpack_counts(p))[min(max(int(k), 0), len(c) - 1)])
                  for p, k in zip(packed, n, strict=True)]
        return _series(values)

    return ask(counts, n_chars)


def longest_prefix(counts: Column | str, budget: int) -> Column:
    """Code points of the longest prefix that by itself has at most ``budget`` tokens."""
    @F.pandas_udf("long")
    def ask(packed):
        return _series([None if p is None else int(np.flatnonzero(unpack_counts(p) <= budget)[-1]) for p in packed])

    return ask(counts)


def _series(values: list):
    import pandas as pd

    return pd.Series(values, dtype="Int64")

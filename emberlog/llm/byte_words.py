"""Byte-level BPE by words: cut a text as the tokenizer does, and keep what each word gives.

A byte-level tokenizer cuts a text into words by a fixed pattern and encodes each word alone, so a word needs the
library once a worker. Texts of Latin-1 characters are cut by the same pattern written for ``re``; in all others,
where Unicode versions matter, the library's own pre-tokenizer cuts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import regex

#: Words a worker keeps at most, so memory is bounded. Results don't depend on it.
KEPT_WORDS = 600_000


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the public tokenizers of the machine that asks."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(pattern: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if regex.match(pattern, chr(c)))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary of byte-level tokenizers."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {byte: chr(byte) for byte in shown}
    hidden = (byte for byte in range(256) if byte not in table)
    return table | {byte: chr(256 + n) for n, byte in enumerate(hidden)}


class ByteWords:
    """A byte-level tokenizer file as words: ``segments`` and ``words`` cut, ``pieces`` encodes one word."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        cut = described["pre_tokenizer"] or {}
        plain = all(not token[flag] for token in described["added_tokens"]
                    for flag in ("single_word", "lstrip", "rstrip"))
        if (described["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
                or not cut.get("use_regex", True) or described["model"].get("ignore_merges") or not plain):
            raise ValueError(f"{name} is not a plain byte-level tokenizer")
        self.model = self.tokenizer.model
        self.vocabulary = described["model"]["vocab"]
        self.specials = {token["content"]: token["id"] for token in described["added_tokens"]}
        self._special = (re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
                         if self.specials else None)
        self._shown = byte_alphabet()
        letter, number, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
        self._latin = re.compile(
            f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")
        self._latin_gap = re.compile(f"[{space}]{{2,}}(?=[^{space}])")
        self._gap = regex.compile(r"\s{2,}(?=\S)")

    def segments(self, text: str) -> list[str]:
        """Plain text at even places, special strings at odd ones."""
        return self._special.split(text) if self._special else [text]

    def words(self, segment: str) -> list[str]:
        try:
            segment.encode("latin-1")
        except UnicodeEncodeError:
            return [segment[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment)]
        return self._latin.findall(segment)

    def gaps(self, segment: str):
        """Runs of two or more white-space characters before something else, as matches."""
        try:
            segment.encode("latin-1")
        except UnicodeEncodeError:
            return self._gap.finditer(segment)
        return self._latin_gap.finditer(segment)

    def shown(self, word: str) -> str:
        """The word's bytes in the alphabet of the vocabulary."""
        return word.encode("utf-8").decode("latin-1").translate(self._shown)

    def pieces(self, shown: str):
        return self.model.tokenize(shown)


class Kept(dict):
    """A table filled on demand by ``make``. ``trim`` drops the newer half once it is large: frequent keys come early."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self, most: int = KEPT_WORDS) -> None:
        if len(self) > most:
            for key in list(islice(reversed(self), len(self) // 2)):
                del self[key]

"""Text analysis and message rendering."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlog.schemas import REPEAT_PREFIX_CHARS

# The word rules of the standard text analysis. Letters, digits and "_" run on; some
# marks join two letters, some two digits; an ideograph is a word; longer words are cut.
LETTER = r"\p{L}\p{Nl}\p{M}"
DIGIT = r"\p{Nd}"
IDEOGRAPH = r"\p{IsHan}\p{IsHiragana}"
LETTER_JOINT = r":.'\u00b7\u2018\u2019\u2024\u2027"
DIGIT_JOINT = r".,;'\u2018\u2019\u2024\u2044"
MAX_WORD = 255
# N-gram lengths of the path analysis.
MIN_GRAM = 2
MAX_GRAM = 5

# ASCII stands first in each class, which is the quick way out for most characters.
WORD_LETTER = f"[a-z[{LETTER}&&[^{IDEOGRAPH}]]]"
WORD_DIGIT = f"[0-9{DIGIT}]"
WORD_START = f"[a-z0-9[{LETTER}{DIGIT}&&[^{IDEOGRAPH}]]]"
WORD_PART = f"[a-z0-9_[{LETTER}{DIGIT}&&[^{IDEOGRAPH}]]]"
JOINT = (f"(?:[{LETTER_JOINT}](?<={WORD_LETTER}.)(?={WORD_LETTER})"
         f"|[{DIGIT_JOINT}](?<={WORD_DIGIT}.)(?={WORD_DIGIT}))")
WORD = f"_*+{WORD_START}{WORD_PART}*+(?:{JOINT}{WORD_PART}++)*+|[{IDEOGRAPH}]"


def unless_blank(value: Column, default: str) -> Column:
    """``value``, or ``default`` where it is null or has only spaces and control characters."""
    return F.coalesce(F.when(~value.rlike(r"\A[\x00-\x20]*\z"), value), F.lit(default))


def normalize_message(content: Column, chars: int = REPEAT_PREFIX_CHARS) -> Column:
    """Grouping key of an error text: its first characters."""
    return F.coalesce(F.substring(content, 1, chars), F.lit(""))


def contains_ci(text: Column, wanted: str) -> Column:
    """Case-insensitive literal substring test; no character of ``wanted`` is a wildcard."""
    return F.lower(text).contains(F.lower(F.lit(wanted)))


def tokens(content: Column) -> Column:
    """Lower-case tokens of a text, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(WORD), F.lit(0))

    def cut(words: Column) -> Column:
        pieces = F.flatten(F.transform(words, lambda word: F.transform(
            F.sequence(F.lit(1), F.length(word), F.lit(MAX_WORD)),
            lambda start: F.substring(word, start, MAX_WORD))))
        return F.when(F.exists(words, lambda word: F.length(word) > MAX_WORD), pieces).otherwise(words)

    # The one-element array names the words, so that the text is matched once.
    return F.transform(F.array(found), cut)[0]


def ngrams(words: Column, low: int = MIN_GRAM, high: int = MAX_GRAM) -> Column:
    """Distinct character n-grams of every token. Repeated tokens are dropped before expansion."""
    def grams_of(word: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.least(F.length(word), F.lit(high)))
        return F.flatten(F.transform(sizes, lambda size: F.transform(
            F.sequence(F.lit(1), F.length(word) - size + 1),
            lambda start: F.substring(word, start, size))))

    long_enough = F.filter(F.array_distinct(words), lambda word: F.length(word) >= low)
    return F.array_distinct(F.flatten(F.transform(long_enough, grams_of)))


def query_terms(spark: SparkSession, keyword: str, grams: bool = False) -> list[str]:
    """Distinct tokens, or n-grams, of a search keyword by the same analysis, as plain values."""
    words = tokens(F.lit(keyword))
    analyzed = spark.range(1).select(ngrams(words) if grams else F.array_distinct(words))
    return sorted(analyzed.first()[0])


def burst_message(threshold: int, window_seconds: int, source: Column, content: Column) -> Column:
    return F.format_string("%d ERROR logs within %d seconds. Latest error: %s - %s",
                           F.lit(threshold), F.lit(window_seconds), source, content)


def repeat_message(source: Column, window_seconds: int, count: Column, content: Column) -> Column:
    return F.format_string(
        "Repeated error: source '%s' logged %d similar errors within %d seconds. Latest error: %s",
        source, count, F.lit(window_seconds), content)


def pattern_subject(name: Column) -> Column:
    return F.concat(F.lit("Log pattern detected: "), name)

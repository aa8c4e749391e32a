"""Sizes, rates and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def original_size(content: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(content), F.lit(0))


def round2(value: Column) -> Column:
    """Two decimals, ties up."""
    return F.floor(value * 100 + F.lit(0.5)).cast("double") / F.lit(100.0)


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, unrounded; 0 where ``whole`` is 0."""
    return (F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0))
            .otherwise(F.lit(0.0)))


def error_rate(errors: Column, total: Column) -> Column:
    """Error share in percent with two decimals."""
    return round2(percent(errors, total))


def compression_ratio(original: Column, stored: Column) -> Column:
    """Saved share in percent with two decimals; 0 for empty input."""
    saved = F.lit(1.0) - stored.cast("double") / original.cast("double")
    return F.when(original > 0, round2(saved * 100)).otherwise(F.lit(0.0))

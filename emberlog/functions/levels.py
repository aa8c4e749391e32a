"""Column expressions on log levels, severities and service status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schemas import DEFAULT_LEVEL, LEVEL_RANKS, LEVELS, SEVERITIES


def level_rank(level: Column) -> Column:
    """Numeric rank of a level in any case; 0 for null and for unknown names."""
    name = F.upper(level)
    ranked = reduce(lambda acc, item: acc.when(name == item[0], F.lit(item[1])),
                    LEVEL_RANKS.items(), F)
    return ranked.otherwise(F.lit(0))


def levels_from(minimum: str | None) -> list[str] | None:
    """Levels ranked at least like ``minimum``; None where that is every level, unknown ones too."""
    least = LEVEL_RANKS.get((minimum or "").upper(), 0)
    return [level for level, rank in LEVEL_RANKS.items() if rank >= least] if least else None


def derive_level(line: Column) -> Column:
    """Level named in a raw line: the first of ERROR, WARN, DEBUG that occurs, else INFO."""
    return (F.when(line.contains("ERROR"), F.lit("ERROR"))
            .when(line.contains("WARN"), F.lit("WARN"))
            .when(line.contains("DEBUG"), F.lit("DEBUG"))
            .otherwise(F.lit(DEFAULT_LEVEL)))


def known_level(level: Column) -> Column:
    """Upper-cased level, with null and unknown names counted as INFO."""
    name = F.upper(level)
    return F.when(name.isin(*LEVELS), name).otherwise(F.lit(DEFAULT_LEVEL))


def is_error(level: Column) -> Column:
    """ERROR in any case, as the burst monitor and the meters see it."""
    return F.upper(level) == "ERROR"


def is_exact_error(level: Column) -> Column:
    """ERROR in this exact case, as the repeated-error pattern sees it."""
    return level == "ERROR"


def severity_rank(severity: Column) -> Column:
    """Position of a severity in its order, INFO = 0."""
    ranked = reduce(lambda acc, item: acc.when(severity == item[1], F.lit(item[0])),
                    enumerate(SEVERITIES), F)
    return ranked.otherwise(F.lit(-1))


def system_status(error_rate: Column, response_ms: Column) -> Column:
    """Service status from an error rate in percent and a response time in milliseconds."""
    # Above 15 % or 500 ms is DEGRADED, above 5 % or 200 ms is WARNING.
    return (F.when((error_rate > 15.0) | (response_ms > 500), F.lit("DEGRADED"))
            .when((error_rate > 5.0) | (response_ms > 200), F.lit("WARNING"))
            .otherwise(F.lit("UP")))

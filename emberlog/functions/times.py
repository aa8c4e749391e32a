"""Expressions on zone-less timestamps. None of them depends on the session time zone."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schemas import LOCAL_ZONE

# The range presets the dashboard offers, in days; the first is the default.
RANGE_PRESETS = {"24h": 1, "7d": 7, "30d": 30}

MICROS = 1_000_000


def at(moment: datetime | str | Column) -> Column:
    """A timestamp without zone from a literal."""
    if isinstance(moment, Column):
        return moment
    return F.lit(str(moment)).cast("timestamp_ntz")


def on(day: date | str | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def log_date(ts: Column) -> Column:
    return ts.cast("date")


def log_hour(ts: Column) -> Column:
    return F.hour(ts).cast("int")


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def to_local_time(ts: Column, source_zone: str = "UTC", zone: str = LOCAL_ZONE) -> Column:
    """Wall time in ``zone`` of a request instant given as wall time in ``source_zone``."""
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), ts)


def _seconds(ts: Column) -> Column:
    return F.extract(F.lit("SECOND"), ts)


def _before(ts: Column, seconds: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def to_second(ts: Column) -> Column:
    """Cut to whole seconds. Truncation functions would go through the session time zone."""
    return _before(ts, _seconds(ts) % 1)


def to_minute(ts: Column) -> Column:
    return _before(ts, _seconds(ts))


def on_the_hour(ts: Column) -> Column:
    return (F.minute(ts) == 0) & (_seconds(ts) == 0)


def at_midnight(ts: Column) -> Column:
    return (F.hour(ts) == 0) & on_the_hour(ts)


def iso_text(ts: Column) -> Column:
    """ISO local date-time, as in ``2024-01-01T10:00:00.5``."""
    return F.translate(ts.cast("string"), " ", "T")


def plain_text(ts: Column) -> Column:
    """Date and time to the second, as in ``2024-01-01 10:00:00``."""
    return F.substring(ts.cast("string"), 1, 19)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    seconds = (F.unix_date(ts.cast("date")).cast("long") * 86400
               + F.hour(ts) * 3600 + F.minute(ts) * 60)
    fraction = _seconds(ts) * MICROS
    return seconds * MICROS + fraction.cast("long")


def from_micros(us: Column) -> Column:
    """Inverse of ``micros``."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days = F.floor(us / F.lit(86400 * MICROS)).cast("int")
    rest = us - days.cast("long") * (86400 * MICROS)
    seconds = (rest.cast("decimal(20,0)") / F.lit(MICROS).cast("decimal(20,0)")).cast("decimal(18,6)")
    return epoch + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def instant(ts: Column) -> Column:
    """A zone-less time as an instant, read as UTC: watermarks and state need one."""
    return F.timestamp_micros(micros(ts))


def wall_time(moment: Column) -> Column:
    """Inverse of ``instant``."""
    return from_micros(F.unix_micros(moment))


def parse(moment: datetime | str) -> datetime:
    return moment if isinstance(moment, datetime) else datetime.fromisoformat(str(moment))


def preset_bounds(as_of: datetime | str, preset: str | None = None) -> tuple[datetime, datetime]:
    """(start, end) of a named range ending at ``as_of``; unknown names mean the last 24 hours."""
    end = parse(as_of)
    return end - timedelta(days=RANGE_PRESETS.get(preset or "24h", 1)), end


def day_bounds(day: date | str) -> tuple[datetime, datetime]:
    """Start of a day and start of the next one."""
    start = datetime.combine(date.fromisoformat(str(day)), datetime.min.time())
    return start, start + timedelta(days=1)

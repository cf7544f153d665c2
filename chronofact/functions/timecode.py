"""Media clock text: [HH:]MM:SS[.mmm] and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the accepted timecode.
TIMECODE = r"^(?:(\d+):)?([0-5]?\d):([0-5]\d(?:\.\d+)?)$"


def format_millis(millis: Column) -> Column:
    """HH:MM:SS.mmm, rounded to milliseconds before the carry; null for null and for what is not finite."""
    ms = F.round(F.abs(millis)).cast("long")
    shown = F.format_string(
        "%s%02d:%02d:%02d.%03d",
        F.when((millis < 0) & (ms > 0), F.lit("-")).otherwise(F.lit("")),
        F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
    )
    return F.when(millis.isNotNull() & ~F.isnan(millis) & (F.abs(millis) < 1e18), shown)


def format_timecode(seconds: Column) -> Column:
    """``format_millis`` of seconds. Finer whole units go there themselves: as seconds, half a millisecond may fall short."""
    return format_millis(seconds * 1000)


def parse_timecode(text: Column) -> Column:
    """Seconds of a timecode or of plain non-negative seconds; null where the text is neither."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, TIMECODE, i)
    hours = F.when(part(1) == "", F.lit(0)).otherwise(part(1).try_cast("long"))
    clock = hours * 3600.0 + part(2).try_cast("long") * 60.0 + part(3).try_cast("double")
    return F.when(t.rlike(TIMECODE), clock).when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))


def format_span(start: Column, end: Column) -> Column:
    both = F.concat(format_timecode(start), F.lit(" → "), format_timecode(end))
    return F.when(end <= start, format_timecode(start)).otherwise(both)

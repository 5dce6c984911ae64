"""Dates out of texts of many formats, and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted layouts in the order in which they are tried, as (pattern, places of year, month, day, hour, minute, second, half-day).
LAYOUTS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})(?:Z|[+-]\d{2}:?\d{2})$", (1, 2, 3, 4, 5, 6, 0)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})$", (1, 2, 3, 4, 5, 6, 0)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$", (1, 2, 3, 4, 5, 6, 0)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2})$", (3, 2, 1, 4, 5, 0, 0)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+-\s+(\d{1,2}):(\d{1,2})$", (3, 2, 1, 4, 5, 0, 0)),
    (r"^(\d{1,2}):(\d{1,2})\s+(\d{1,2})/(\d{1,2})/(\d{4})$", (5, 4, 3, 1, 2, 0, 0)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1, 0, 0, 0, 0)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3, 0, 0, 0, 0)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\s+([AaPp][Mm])$", (3, 1, 2, 4, 5, 6, 7)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$", (3, 1, 2, 4, 5, 6, 0)),
)
# What is looked for anywhere in a text that has none of the layouts; the time is lost then.
ANYWHERE = ((r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3, 0, 0, 0, 0)), (r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1, 0, 0, 0, 0)))


def _moment(text: Column, pattern: str, places: tuple[int, ...]) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("int") if k else F.lit(0)
    year, month, day, hour, minute, second, half = places
    h = part(hour)
    if half:
        mark = F.lower(F.regexp_extract(text, pattern, half))
        h = F.when(h.between(1, 12), h % 12 + F.when(mark == "pm", 12).otherwise(0))
    made = F.try_make_timestamp_ntz(part(year), part(month), part(day), h, part(minute), part(second).cast("decimal(16,6)"))
    return F.when(text.rlike(pattern), made)


def parse_datetime(raw: Column) -> Column:
    """The moment in a text as it stands there (an offset is dropped), or null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r" \| ", " "), r"\|", " "))
    return F.coalesce(*[_moment(text, p, places) for p, places in (*LAYOUTS, *ANYWHERE)])


def age(moment: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days; moments that are yet to come are just now, and null is an empty text."""
    minutes = F.floor(F.timestamp_diff("SECOND", moment, now) / 60).cast("long")
    return F.when(minutes.isNull(), "").when(minutes < 0, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hours"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" days")))

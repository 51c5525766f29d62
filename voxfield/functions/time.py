"""Column functions on times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted timestamp patterns, tried in order; without a zone they are UTC.
PATTERNS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"]


def iso_week(ts: Column) -> Column:
    """ISO year and week, as 2024-W05."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parse_posted_at(s: Column) -> Column:
    """The first pattern that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in PATTERNS])


def since(window: Column, now: Column) -> Column:
    """now less a window such as 90d, 24h, 2w or 6m (a month is 30 days); null for another form."""
    n = F.regexp_extract(window, "^([0-9]+)[dhwm]$", 1).try_cast("int")
    unit = F.regexp_extract(window, "^[0-9]+([dhwm])$", 1)
    hours = F.when(unit == "h", n).when(unit == "d", n * 24).when(unit == "w", n * 168).when(unit == "m", n * 720)
    return now - F.make_dt_interval(F.lit(0), hours)


def relative_date(s: Column, now: Column) -> Column:
    """`3 days ago` and the like against now (month 30 days, year 365); null for another form."""
    n = F.regexp_extract(F.lower(s), r"([0-9]+)\s+(?:second|minute|hour|day|week|month|year)s?\s+ago", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(s), r"[0-9]+\s+(second|minute|hour|day|week|month|year)s?\s+ago", 1)
    step = F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800).when(unit == "month", 2592000).when(unit == "year", 31536000)
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * step).cast("decimal(18,6)"))


#: Absolute dates on review pages, tried in order.
DATES = ["yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy"]


def said_date(s: Column, now: Column) -> Column:
    """A date as people write it: `3 days ago` (hours to months), `yesterday`, `today`, 2024-01-15, 15 Jan 2024, 15 January 2024 or Jan 15, 2024, in either case; null for another form."""
    text = F.initcap(F.trim(s))
    ago = F.when(F.rlike(F.lower(s), F.lit(r"[0-9]+\s*(hour|day|week|month)s?\s*ago")), relative_date(F.regexp_replace(F.lower(s), r"([0-9])\s*(hour|day|week|month)(s?)\s*ago", "$1 $2$3 ago"), now))
    dates = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in DATES]
    return F.coalesce(ago, F.when(text == "Yesterday", now - F.make_dt_interval(F.lit(1))).when(text == "Today", now), *dates)


def epoch(n: Column) -> Column:
    """Seconds since 1970, or milliseconds beyond 1e10."""
    return F.timestamp_millis(F.when(n > 10_000_000_000, n).otherwise(n * 1000))

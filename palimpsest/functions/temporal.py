"""Time windows, ages and time parsing."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths in days; a month is 30 days and a year 365.
UNITS = {"h": 1 / 24, "d": 1, "w": 7, "m": 30, "y": 365}


def window_bounds(spec: str, as_of: str) -> tuple[datetime, datetime] | None:
    """Bounds of <n>h, <n>d, <n>w, <n>m, <n>y, of "a..b" and "a,b"; None if spec is none of these."""
    now = datetime.fromisoformat(as_of)
    if found := re.fullmatch(r"\s*(\d+)\s*([hdwmy])\s*", spec):
        return now - timedelta(days=int(found[1]) * UNITS[found[2]]), now
    if found := re.fullmatch(r"\s*(\S+?)\s*(?:\.\.|,)\s*(\S+)\s*", spec):
        try:
            return datetime.fromisoformat(found[1]), datetime.fromisoformat(found[2])
        except ValueError:
            return None
    return None


def inferred_spec(text: str) -> str | None:
    """The window spec of phrases such as yesterday, last week or last 3 days."""
    text = text.lower()
    if found := re.search(r"\b(?:last|past)\s+(\d+)\s+(hour|day|week|month|year)s?\b", text):
        return found[1] + found[2][0]
    for phrase, spec in (("yesterday", "2d"), ("today", "1d"), ("last week", "1w"), ("last month", "1m"), ("last year", "1y")):
        if phrase in text:
            return spec
    return None


def parsed(text: Column) -> Column:
    """A timestamp in UTC of ISO text with or without T, fraction, Z or offset, or of a date; null of anything else."""
    shapes = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(s)) for s in shapes])


def age_text(seconds: Column) -> Column:
    """Age in words: seconds, minutes, hours, days, weeks, months, years, rounded half to even."""

    def words(unit: int, name: str) -> Column:
        n = F.bround(seconds / unit).cast("long")
        return F.concat(n.cast("string"), F.lit(" " + name), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, words(60, "minute"))
        .when(seconds < 86400, words(3600, "hour"))
        .when(seconds < 7 * 86400, words(86400, "day"))
        .when(seconds < 30 * 86400, words(7 * 86400, "week"))
        .when(seconds < 365 * 86400, words(30 * 86400, "month"))
        .otherwise(words(365 * 86400, "year"))
    )


def monday_week(ts: Column) -> Column:
    """Year and week as %Y-W%W: weeks begin on Monday, days before the first Monday are week 00."""
    day, weekday = F.dayofyear(ts), F.weekday(ts)
    week = F.floor((day + 6 - weekday) / 7).cast("int")
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))

"""Dates that a text speaks of, as column expressions: written dates, phrases relative to a reference day, and intervals."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, days, seasons (with their middle month) and vague terms (with days from the reference).
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SEASONS = {"spring": 4, "summer": 7, "autumn": 10, "fall": 10, "winter": 1}
VAGUE = {"yesterday": -1, "today": 0, "tomorrow": 1, "recently": -7, "a while ago": -30, "soon": 7, "the other day": -3, "last night": -1}
UNIT = r"(day|week|month|year)s?"

ISO = r"\d{4}-\d{2}-\d{2}"
WRITTEN = MONTH + r"\s+\d{1,2},?\s*\d{4}"
DAY_FIRST = r"\d{1,2}\s+" + MONTH + r",?\s*\d{4}"
MONTH_YEAR = r"(?<!\d{1,2}\s{1,3})" + MONTH + r"\s+\d{4}"
SLASHES = r"\d{1,2}/\d{1,2}/\d{2,4}"
#: In the order in which dates of a text are counted.
FORMS = (ISO, WRITTEN, DAY_FIRST, MONTH_YEAR, SLASHES)
DATE = "(?:" + "|".join((ISO, WRITTEN, DAY_FIRST, MONTH_YEAR, SLASHES)) + ")"


def day(year: Column, month: Column, of_month: Column) -> Column:
    """A date, null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), of_month.cast("string"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def written(text: Column) -> Column:
    """The date of a text that is one of FORMS; a month and year is its first day, two figures of a year are 1969 to 2068."""
    month = (F.instr(F.lit(MONTHS), F.regexp_extract(text, "([a-z]{3})", 1)) + 2) / 3
    named = day(_number(text, r"(\d{4})$"), month.cast("int"), F.coalesce(_number(text, r"^(\d{1,2})\s"), _number(text, r"^[a-z]+\s+(\d{1,2})(?!\d)"), F.lit(1)))
    a, b, y = (_number(text, p) for p in (r"^(\d{1,2})/", r"^\d{1,2}/(\d{1,2})/", r"/(\d+)$"))
    y = F.when(y >= 100, y).when(y <= 68, y + 2000).otherwise(y + 1900)
    slashed = F.when(a <= 12, day(y, a, b)).otherwise(day(y, b, a))
    return F.when(text.rlike("^" + ISO + "$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))).when(text.contains("/"), slashed).otherwise(named)


def moved(reference: Column, count: Column, unit: Column) -> Column:
    return (
        F.when(unit == "year", F.add_months(reference, count * 12)).when(unit == "month", F.add_months(reference, count)).when(unit == "week", F.date_add(reference, count * 7)).otherwise(F.date_add(reference, count))
    )


def phrase(text: Column, reference: Column) -> Column:
    """The day of last, next or this with a weekday, week, month, year or season; of a season the middle of its middle month."""
    which, what = F.regexp_extract(text, r"^(\w+)", 1), F.regexp_extract(text, r"(\w+)$", 1)
    sign = F.when(which == "last", -1).when(which == "next", 1).otherwise(0)
    target = F.array_position(F.array(*map(F.lit, WEEKDAYS)), what).cast("int") - 1
    ahead, back = F.pmod(target - F.weekday(reference), F.lit(7)), F.pmod(F.weekday(reference) - target, F.lit(7))
    by_day = F.when(which == "last", F.date_sub(reference, F.when(back > 0, back).otherwise(7))).when(which == "next", F.date_add(reference, F.when(ahead > 0, ahead).otherwise(7))).otherwise(F.date_add(reference, ahead))
    seasons = F.create_map(*[F.lit(x) for pair in SEASONS.items() for x in pair])
    season = F.try_element_at(seasons, what)
    return F.when(target >= 0, by_day).when(season.isNotNull(), day(F.year(reference) + sign, season, F.lit(15))).otherwise(moved(reference, sign, what))


def _from(reference: Column, sign: int, count: Column) -> Column:
    return moved(reference, count["n"] * sign, count["unit"])


def all_dates(text: Column, reference: Column) -> Column:
    """array<date>: every date of a text, form by form, then phrases, then counts of days and the like ago and ahead, then one vague term."""
    t = F.lower(text)
    found = [F.transform(F.regexp_extract_all(t, F.lit(rf"\b({form})\b"), 1), written) for form in FORMS]
    what = "|".join((*WEEKDAYS, "week", "month", "year", *SEASONS))
    found.append(F.transform(F.regexp_extract_all(t, F.lit(rf"\b((?:last|next|this)\s+(?:{what}))\b"), 1), lambda p: phrase(p, reference)))
    for pattern, sign in ((rf"\b\d{{1,5}}\s+{UNIT}\s+ago\b", -1), (rf"\bin\s+\d{{1,5}}\s+{UNIT}\b", 1)):
        count = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda p: F.struct((_number(p, r"(\d+)")).alias("n"), F.regexp_extract(p, UNIT, 1).alias("unit")))
        found.append(F.transform(count, partial(_from, reference, sign)))
    vague = F.lit(None).cast("date")
    for term, days in reversed(VAGUE.items()):
        vague = F.when(t.contains(term), F.date_add(reference, days)).otherwise(vague)
    return F.filter(F.concat(*found, F.array(vague)), lambda d: d.isNotNull())


def spoken_of(text: Column, reference: Column) -> Column:
    """struct<referenced, starts, ends>: the first date, and the interval, of a text as seen from a reference day.

    An interval is from one written date to another, else some days or more from the reference on (for 3 weeks), else the
    first two dates in their order. Null text has none.
    """
    t = F.lower(text)
    span = rf"\bfrom\s+({DATE})\s+to\s+({DATE})\b"
    a, b = (F.when(t.rlike(span), written(F.regexp_extract(t, span, k))) for k in (1, 2))
    from_to = a.isNotNull() & b.isNotNull()
    lasting = rf"\bfor\s+(\d{{1,5}})\s+{UNIT}\b"
    length = F.when(t.rlike(lasting), moved(reference, _number(t, lasting), F.regexp_extract(t, lasting, 2)))

    def read(dates: Column) -> Column:
        two = F.array_sort(F.slice(dates, 1, 2))
        pair = F.size(two) == 2
        starts = F.when(from_to, a).when(length.isNotNull(), reference).when(pair, F.get(two, F.lit(0)))
        ends = F.when(from_to, b).when(length.isNotNull(), length).when(pair, F.get(two, F.lit(1)))
        return F.struct(F.get(dates, F.lit(0)).alias("referenced"), starts.alias("starts"), ends.alias("ends"))

    # As the one item of an array the dates are searched for once, not at each place where they are used.
    return F.when(text.isNotNull(), F.get(F.transform(F.array(all_dates(text, reference)), read), F.lit(0)))

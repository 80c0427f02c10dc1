"""Dates in texts: each form against the day it means."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.functions import dates

WEDNESDAY = "2026-03-11"
#: Text, the first date, start and end of the interval.
TABLE = [
    ("Meeting on 2026-04-15", "2026-04-15", None, None),
    ("Born on March 15, 2000.", "2000-03-15", None, None),
    ("born on MAR 5 2000", "2000-03-05", None, None),
    ("on 8 May, 2023 at noon", "2023-05-08", None, None),
    ("in May 2023", "2023-05-01", None, None),
    ("Deadline is 3/15/2026", "2026-03-15", None, None),
    ("15/3/26 or so", "2026-03-15", None, None),
    ("3/4/70", "1970-03-04", None, None),
    ("no date 2026-02-30, nor 13/13/2020", None, None, None),
    ("No dates in this text at all", None, None, None),
    ("", None, None, None),
    ("I went there last Monday", "2026-03-09", None, None),
    ("last wednesday", "2026-03-04", None, None),
    ("next Wednesday", "2026-03-18", None, None),
    ("this wednesday", "2026-03-11", None, None),
    ("this Tuesday", "2026-03-17", None, None),
    ("Meeting next week", "2026-03-18", None, None),
    ("last month", "2026-02-11", None, None),
    ("next year", "2027-03-11", None, None),
    ("last summer", "2025-07-15", None, None),
    ("next winter", "2027-01-15", None, None),
    ("That happened 3 days ago", "2026-03-08", None, None),
    ("1 month ago", "2026-02-11", None, None),
    ("Will be ready in 2 weeks", "2026-03-25", None, None),
    ("in 10 years", "2036-03-11", None, None),
    ("in 1234567 days", None, None, None),
    ("I saw her yesterday", "2026-03-10", None, None),
    ("Meeting tomorrow at 3pm", "2026-03-12", None, None),
    ("She recently joined; soon more", "2026-03-04", None, None),
    ("the other day", "2026-03-08", None, None),
    ("From January 1, 2026 to March 1, 2026 we traveled.", "2026-01-01", "2026-01-01", "2026-03-01"),
    ("from 2026-05-02 to 2026-05-01", "2026-05-02", "2026-05-02", "2026-05-01"),
    ("I worked there for 3 months", None, "2026-03-11", "2026-06-11"),
    ("for 2 days from 2026-01-05", "2026-01-05", "2026-03-11", "2026-03-13"),
    ("Events on 2026-06-01 and 2026-01-01 were important", "2026-06-01", "2026-01-01", "2026-06-01"),
    ("3/1/2026, then 2 May 2025", "2025-05-02", "2025-05-02", "2026-03-01"),
]


def test_each_form(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TABLE)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["d"] for r in frame.select("i", dates.spoken_of(F.col("t"), F.lit(WEDNESDAY).cast("date")).alias("d")).collect()}
    assert got.pop(99) is None
    day = lambda x: None if x is None else dt.date.fromisoformat(x)
    found = {TABLE[i][0]: tuple(d) for i, d in got.items()}
    assert found == {t: tuple(map(day, want)) for t, *want in TABLE}


def test_ends_of_months_and_other_references(spark):
    rows = [("2024-01-31", "next month", "2024-02-29"), ("2024-02-29", "next year", "2025-02-28"), ("2024-03-31", "1 month ago", "2024-02-29"), ("2024-03-03", "last sunday", "2024-02-25")]
    frame = spark.createDataFrame(rows, "r string, t string, want string")
    for r in frame.select("want", dates.spoken_of(F.col("t"), F.to_date("r"))["referenced"].cast("string").alias("got")).collect():
        assert r["got"] == r["want"]

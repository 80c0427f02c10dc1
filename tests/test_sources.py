from __future__ import annotations

import pytest

from palimpsest.functions import temporal
from palimpsest.sources import files


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nAnn: hello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nno speaker here\n")
    found = sorted((r["start"], r["speaker"], r["text"]) for r in files.transcripts(spark, str(tmp_path)).collect())
    assert found == [("00:00:01,000", "Ann", "hello there"), ("00:00:03,000", None, "no speaker here")]


def test_mailbox(spark, tmp_path):
    (tmp_path / "m.mbox").write_text("From a@b Mon\nFrom: a@b.example\nSubject: One\nDate: today\n\nbody one\n\nFrom c@d Tue\nFrom: c@d.example\nSubject: Two\n\nbody two\n")
    found = sorted((r["sender"], r["subject"], r["body"]) for r in files.mailbox(spark, str(tmp_path)).collect())
    assert found == [("a@b.example", "One", "body one"), ("c@d.example", "Two", "body two")]


def test_calendar(spark, tmp_path):
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:Long\n er title\nDTSTART;TZID=UTC:20240101T100000\nDTEND:20240101T110000\nEND:VEVENT\nEND:VCALENDAR\n")
    row = files.calendar(spark, str(tmp_path)).first()
    assert (row["uid"], row["summary"], row["start"]) == ("1", "Longer title", "20240101T100000")


def test_python_symbols(spark, tmp_path):
    (tmp_path / "m.py").write_text("class A:\n    def f(self):\n        return g()\n")
    (tmp_path / "bad.py").write_text("def (:")
    found = {(r["kind"], r["name"], tuple(r["calls"])) for r in files.python_symbols(spark, str(tmp_path)).collect()}
    assert found == {("class", "A", ("g",)), ("function", "f", ("g",))}


def test_bundle_round_trip_and_damage(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i long, t string")
    files.write_bundle({"x": rows}, str(tmp_path / "b"))
    assert files.verified_bundle(spark, str(tmp_path / "b"), {"x": "i long, t string"})["x"].count() == 2
    part = next((tmp_path / "b/x").glob("part-*.json"))
    part.write_text(part.read_text() + '{"i":3,"t":"c"}\n')
    for crc in (tmp_path / "b/x").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        files.verified_bundle(spark, str(tmp_path / "b"), {"x": "i long, t string"})


def test_window_specs():
    lo, hi = temporal.window_bounds("2w", "2024-02-01 00:00:00")
    assert (hi - lo).days == 14
    assert temporal.window_bounds("2024-01-01..2024-01-05", "2024-02-01")[1].day == 5
    assert temporal.window_bounds("soon", "2024-02-01") is None
    assert temporal.inferred_spec("what happened in the last 3 weeks?") == "3w"

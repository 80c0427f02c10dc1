"""A folder as a stream: new files, restarts after failures, files that can't be read."""

from __future__ import annotations

import pytest

from palimpsest.streaming import folders

CUES = "1\n00:00:01,000 --> 00:00:02,000\nAda: Hello é\n\n2\n00:00:03,000 --> 00:00:04,000\nBob: Good day\nto you\n\n3\n00:00:05,000 --> 00:00:06,000\nno name here\n"


def run(spark, tmp_path, **more):
    folders.take_in(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), **more).awaitTermination(120)


def found(spark, tmp_path, kind="transcript"):
    return sorted((r["path"].rpartition("/")[2], r["content"], r["speaker"]) for r in folders.taken_in(spark, str(tmp_path / "out")).where(f"kind = '{kind}'").collect())


def test_files_between_runs_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.srt").write_text(CUES)
    (tmp_path / "in/b.txt").write_text("plain text")
    (tmp_path / "in/c.pdf").write_text("another kind of file")
    run(spark, tmp_path)
    one = ("a.srt", "Meeting transcript (a.srt):\n[Ada] Hello é\n[Bob] Good day to you\n[unknown] no name here", None)
    two = ("b.txt", "Meeting transcript (b.txt):\nplain text", None)
    assert found(spark, tmp_path) == [one, two]
    assert [r[1:] for r in found(spark, tmp_path, "speaker")] == [(f"{n} participated in meeting: a. Transcript file: a.srt", n) for n in ("Ada", "Bob")]
    (tmp_path / "in/copy.srt").write_text(CUES)  # the same content under another name
    (tmp_path / "in/d.txt").write_text("later")
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert found(spark, tmp_path) == [one, two, ("d.txt", "Meeting transcript (d.txt):\nlater", None)]
    assert len(list((tmp_path / "out/items").glob("batch=*"))) == 2


def test_restart_after_a_failed_batch(spark, tmp_path, monkeypatch):
    """The second batch fails after its items are written and before the rest is; the next run does it again."""
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / f"in/{i}.txt").write_text(f"text {i}")
    told, calls = folders.told_apart, []

    def failing(files):
        calls.append(1)
        good, bad = told(files)
        return good, bad if len(calls) != 2 else bad.selectExpr("raise_error('lost') as path", "length", "reason", "modified").union(good.selectExpr("raise_error('lost')", "1L", "kind", "modified"))

    monkeypatch.setattr(folders, "told_apart", failing)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, files_per_batch=2)
    assert 2 <= len(found(spark, tmp_path)) <= 4
    run(spark, tmp_path, files_per_batch=2)
    assert [r[1].rpartition(":\n")[2] for r in found(spark, tmp_path)] == [f"text {i}" for i in range(5)]
    assert spark.read.parquet(f"{tmp_path}/out/items").count() == 5


def test_unreadable_files_go_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/empty.txt").write_bytes(b"")
    (tmp_path / "in/latin.txt").write_bytes(b"caf\xe9")
    (tmp_path / "in/none.vtt").write_text("WEBVTT\n\nnothing said")
    (tmp_path / "in/good.VTT").write_text("WEBVTT\r\n\r\n00:01.000 --> 00:02.000\r\n<v Ada>Hi\r\n")
    run(spark, tmp_path)
    assert sorted((r["path"].rpartition("/")[2], r["reason"]) for r in folders.put_aside(spark, str(tmp_path / "out")).collect()) == [("latin.txt", "not UTF-8"), ("none.vtt", "no cue")]
    assert found(spark, tmp_path) == [("good.VTT", "Meeting transcript (good.VTT):\n[Ada] Hi", None)]

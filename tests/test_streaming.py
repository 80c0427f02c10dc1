from __future__ import annotations

import datetime as dt

import pytest

from palimpsest.streaming import stateful

SCHEMA = "operation_id long, ts timestamp, user_id long, event_type string, value double"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    def of(*batches):
        source = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(source / f"b{i}"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source / "*"))

    return of


def collected(frame, mode="append"):
    name = f"out_{abs(hash(str(frame)))}_{dt.datetime.now().microsecond}"
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_repeated_submits_pass_once(stream):
    rows = [(1, at(0), 1, "a", 1.0), (2, at(1), 1, "a", 1.0), (1, at(2), 1, "a", 1.0)]
    assert sorted(r["operation_id"] for r in collected(stateful.submitted_once(stream(rows)))) == [1, 2]


def test_windows_count_by_day(stream):
    rows = [(i, at(60 * i), 1, "a", 1.0) for i in range(30)]
    found = collected(stateful.windowed(stream(rows)), "complete")
    assert sorted(r["n"] for r in found) == [6, 24]


def test_sessions_close_after_the_gap(stream):
    rows = [(1, at(0), 7, "a", 1.0), (2, at(60), 7, "a", 1.0), (3, at(60 * 30), 7, "a", 1.0), (4, at(60 * 90), 8, "a", 1.0)]
    found = {(r["user_id"], r["n"]) for r in collected(stateful.sessions(stream(rows, [(5, at(60 * 500), 9, "a", 1.0)])))}
    assert (7, 2) in found and (7, 1) in found


def test_outcomes_settle_after_their_grace(stream):
    first = [(1, at(0), 1, "a", 2.0), (2, at(1), 1, "a", 3.0)]
    later = [(3, at(100), 2, "a", 1.0)]
    found = {(r["key"], r["signals"], r["total"]) for r in collected(stateful.settled_outcomes(stream(first, later)))}
    assert (1, 2, 5.0) in found


def test_latest_state_keeps_the_newest_row(spark, tmp_path):
    keep = stateful.latest_state(str(tmp_path / "t"), "user_id", "ts")
    keep(spark.createDataFrame([(1, at(0), 1, "a", 1.0), (2, at(5), 1, "a", 2.0)], SCHEMA), 0)
    keep(spark.createDataFrame([(3, at(3), 1, "a", 9.0), (4, at(3), 2, "a", 4.0)], SCHEMA), 1)
    assert {(r["user_id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {(1, 2.0), (2, 4.0)}

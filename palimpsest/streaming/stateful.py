"""Structured Streaming forms: idempotent submits, session and window aggregates, pending outcomes, last writer wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def submitted_once(events: DataFrame, key: str = "operation_id", delay: str = "10 minutes") -> DataFrame:
    """The first event of each key; state of a key is dropped once the watermark has passed it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event type of tumbling windows, or of sliding ones with slide."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """user_id, started, n of sessions that close after a gap without events."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def clamped(signals: DataFrame, skew_seconds: int = 60, longest_dwell: float = 3600.0) -> DataFrame:
    """Signals with a time at most skew_seconds after their arrival and a dwell in bounds; invalid ones are left out."""
    latest = F.col("arrived") + F.make_dt_interval(secs=F.lit(skew_seconds))
    rows = signals.where("ts is not null and value is not null and value >= 0")
    return rows.withColumns({"ts": F.least("ts", latest), "value": F.least("value", F.lit(longest_dwell))})


def settled_outcomes(signals: DataFrame, grace_ms: int = 60_000, delay: str = "10 seconds") -> DataFrame:
    """key, signals, total: one row for each key once no signal has come for grace_ms of event time.

    The state of a key is two numbers and a time, whatever the number of its signals.
    """

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "signals": [n], "total": [total]})
            return
        n, total = state.get if state.exists else (0, 0.0)
        latest = 0
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
        state.update((n, total))
        state.setTimeoutTimestamp(max(latest + grace_ms, state.getCurrentWatermarkMs() + 1))

    own = signals.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", delay)
    return own.groupBy("key").applyInPandasWithState(
        settle, "key long, signals long, total double", "n long, total double", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_state(target: str, key: str, order: str):
    """A foreachBatch function that keeps the newest row of each key in a Parquet table, in a new version a batch."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch:
            rows = rows.unionByName(spark.read.parquet(f"{target}/v{epoch - 1}"))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return apply

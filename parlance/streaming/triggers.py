"""The trigger rules over a stream of captures: keyed frequency state, micro-batches, idle sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.triggers import batches

WINDOW_S, THRESHOLD = 300, 3


def frequency_releases(captures: DataFrame, by: str, seconds: int = WINDOW_S, threshold: int = THRESHOLD) -> DataFrame:
    """(key, released_at, size) as soon as a key has ``threshold`` arrivals in the window that no release has taken.

    State: the arrivals of a key that are younger than the window, so it is bounded by the key's rate, and it goes with the
    watermark. Arrivals of one micro-batch are taken in the order of their times; those behind the watermark are dropped by it.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(x for f in frames for x in f["t"]):
            pending = [*(p for p in pending if p >= t - seconds * 1_000_000), t]
            if len(pending) >= threshold:
                out.append((key[0], pd.Timestamp(t, unit="us"), len(pending)))
                pending = []
        state.update((pending,))
        ends = (max(pending) if pending else 0) // 1000 + seconds * 1000
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(ends))
        yield pd.DataFrame(out, columns=["key", "released_at", "size"])

    times = captures.withWatermark("captured_at", f"{seconds} seconds").select(F.col(by).cast("string").alias("key"), "captured_at", F.unix_micros("captured_at").alias("t"))
    return times.groupBy("key").applyInPandasWithState(step, "key string, released_at timestamp, size long", "pending array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def micro_batches(tasks: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, size: int = 8, wait: str = "1500 milliseconds", available_now: bool = False, dead_letters: str | None = None):
    """Hand each micro-batch of tasks, in chunks of ``size`` grouped by ``batch_key``, to ``run``.

    A failing batch doesn't end the stream: its tasks, the batch's number and the error go to the table ``dead_letters`` (by default
    beside the checkpoint), from which they can be run again.
    """
    letters = dead_letters or f"{checkpoint}-dead-letters"

    def each(rows: DataFrame, epoch: int) -> None:
        try:
            run(batches(rows, ["captured_at", "event_id"], "batch_key", size), epoch)
        except Exception as e:
            rows.withColumns({"batch": F.lit(epoch), "error": F.lit(f"{type(e).__name__}: {e}"[:500])}).write.mode("append").parquet(letters)

    writer = tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=wait)).start()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Capture requests as a stream of JSON files that a gateway lands in a folder (the push end point's place)."""
    return spark.readStream.schema("session_id string, trigger string, captured_at timestamp, provider string, pulled string").json(folder)


def plugin_events(events: DataFrame) -> DataFrame:
    """Of a tool's events those that say a session is idle."""
    return events.filter(F.col("event_type") == "session.idle")


def idle(captures: DataFrame, by: str, gap: str = "30 seconds") -> DataFrame:
    """Sessions that a quiet time has ended, as the watermark passes it."""
    return captures.withWatermark("captured_at", gap).groupBy(F.session_window("captured_at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("idle_at"), "n")

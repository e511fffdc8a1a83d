"""Trigger rules over captures and session texts, in their batch form; the streaming form is in ``parlance.streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions import patterns as P


def reasons(text: Column, trigger: Column, severity: tuple[str, ...] = P.SEVERITY, semantic: tuple[str, ...] = P.SEMANTIC, manual: tuple[str, ...] = P.MANUAL) -> Column:
    """manual:*, severity:* and semantic:* reasons, in this order; words match anywhere in the text."""
    low = F.lower(text)
    pick = lambda kind, words, ok: F.transform(F.filter(F.array(*[F.lit(w) for w in words]), ok), lambda w: F.concat(F.lit(f"{kind}:"), w))
    by_hand = F.when(F.exists(F.array(*[F.lit(w) for w in manual]), lambda w: F.startswith(F.lower(trigger), w)), F.array(F.concat(F.lit("manual:"), trigger))).otherwise(F.array().cast("array<string>"))
    return F.concat(by_hand, pick("severity", severity, lambda w: F.contains(low, w)), pick("semantic", semantic, lambda w: F.contains(low, F.lower(w))))


def score(reason_list: Column) -> Column:
    """manual 3, severity and frequency 2, others 1; 1 at least."""
    worth = lambda r: F.when(F.startswith(r, F.lit("manual:")), 3).when(F.startswith(r, F.lit("severity:")) | F.startswith(r, F.lit("frequency:")), 2).otherwise(1)
    return F.greatest(F.lit(1), F.aggregate(reason_list, F.lit(0), lambda s, r: s + worth(r)))


def signature(provider: Column, trigger: Column, text: Column) -> Column:
    return F.concat_ws(":", provider, trigger, F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 160))


def frequency(captures: DataFrame, by: str, seconds: int = 300) -> DataFrame:
    """Arrivals of the same key in the trailing window, the current one included, as ``arrivals``."""
    w = Window.partitionBy(by).orderBy(F.unix_micros("captured_at")).rangeBetween(-seconds * 1_000_000, 0)
    return captures.withColumn("arrivals", F.count("*").over(w))


def released(captures: DataFrame, by: str, seconds: int = 300, threshold: int = 3) -> DataFrame:
    """The keyed rule as a fold over each key's sorted arrivals: pending ones are let go together when there are enough.

    Gives (key, released_at, size). The fold holds a run of one key's arrivals, cut where the key is quiet for the window.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("pending"), F.array().cast("array<struct<at:bigint,n:int>>").alias("out"))

    def go(s: Column, t: Column) -> Column:
        kept = F.concat(F.filter(s["pending"], lambda x: x >= t - seconds * 1_000_000), F.array(t))
        full = F.size(kept) >= threshold
        return F.struct(F.when(full, F.array().cast("array<bigint>")).otherwise(kept).alias("pending"), F.when(full, F.concat(s["out"], F.array(F.struct(t.alias("at"), F.size(kept).alias("n"))))).otherwise(s["out"]).alias("out"))

    # nothing pending outlives a quiet time as long as the window, so a key's arrivals fall into runs
    at = F.unix_micros("captured_at")
    w = Window.partitionBy(by).orderBy("at")
    runs = captures.select(by, at.alias("at")).withColumn("fresh", F.when(F.col("at") - F.lag("at").over(w) <= seconds * 1_000_000, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    times = runs.groupBy(by, "run").agg(F.sort_array(F.collect_list("at")).alias("t")).filter(F.size("t") >= threshold)
    found = times.select(by, F.explode(F.aggregate("t", start, go, lambda s: s["out"])).alias("r"))
    return found.select(by, F.timestamp_micros("r.at").alias("released_at"), F.col("r.n").cast("long").alias("size"))


def batches(tasks: DataFrame, order: list[str], key: str, size: int = 8, partition: list[str] | None = None) -> DataFrame:
    """First-in-first-out chunks of ``size`` tasks, grouped by key inside each; summary-only if any task is.

    Without ``partition`` the queue is global, as one queue is; give the queue's own key to spread it.
    """
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)
    chunked = tasks.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return chunked.groupBy(*(partition or []), "chunk", key).agg(F.array_sort(F.collect_set("session_id")).alias("session_ids"), F.max("trigger_score").alias("trigger_score"), F.count("*").alias("size"), F.when(F.bool_or(F.col("processing_mode") == "summary-only"), "summary-only").otherwise("full").alias("processing_mode"))


def idle_sessions(events: DataFrame, by: str, at: str, gap: str = "30 seconds") -> DataFrame:
    """Runs of activity that a quiet time ends; batch and streaming alike."""
    return events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("idle_at"), "n")


def newest(events: DataFrame, by: str, keep: int = 50, order: tuple[str, ...] = ("captured_at", "event_id")) -> DataFrame:
    """A bounded buffer: of each owner the newest ``keep`` stay."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")


def degraded(tasks: DataFrame, order: list[str], by: list[str], most: int = 50, mode: str = "full", distill: bool = True) -> DataFrame:
    """``processing_mode`` of each task: summary-only if so configured, without distillation, or behind ``most`` others of its queue (``by``)."""
    if mode == "summary-only" or not distill:
        return tasks.withColumn("processing_mode", F.lit("summary-only"))
    waiting = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return tasks.withColumn("processing_mode", F.when(waiting > most, "summary-only").otherwise("full"))

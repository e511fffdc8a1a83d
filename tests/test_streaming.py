from datetime import datetime, timedelta

from parlance.operators import triggers
from parlance.streaming import triggers as live

T0 = datetime(2026, 3, 1)


def test_stream_releases_what_the_batch_does(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=s)) for k, at in {"a": [0, 10, 20, 30, 400, 650, 690], "b": [5, 500, 900], "c": [1, 2, 3, 4, 5, 6]}.items() for s in at]
    df = spark.createDataFrame(rows, "sig string, captured_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.frequency_releases(stream, "sig").writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.released_at, r["size"]) for r in spark.table("released").collect())
    assert got == sorted((r.sig, r.released_at, r["size"]) for r in triggers.released(df, "sig").collect())
    assert [g[0] for g in got] == ["a", "a", "c", "c"]


def test_micro_batches(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "k" if i % 2 else "m", T0 + timedelta(seconds=i), i % 4, "summary-only" if i == 9 else "full") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, session_id string, batch_key string, captured_at timestamp, trigger_score int, processing_mode string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    q = live.micro_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, _: found.extend(b.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert sorted((r.chunk, r.batch_key, r["size"], r.processing_mode) for r in found) == [(0, "k", 4, "full"), (0, "m", 4, "full"), (1, "k", 2, "summary-only"), (1, "m", 2, "full")]

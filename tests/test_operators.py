import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators import archive, distill, triggers
from parlance.sources import transcripts

T0 = datetime(2026, 3, 1)


def test_archive_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a", "demo/repo", T0), ("b", None, T0 + timedelta(hours=30)), ("c", "x", T0)], "session_id string, repo string, captured_at timestamp")
    archive.write(s, str(tmp_path / "lake"))
    back = spark.read.parquet(str(tmp_path / "lake"))
    assert {r.repo for r in back.collect()} == {"demo_repo", "_global", "x"}
    assert {r.session_id for r in archive.scan(back, repo="demo_repo").collect()} == {"a", "b"}
    assert archive.scan(back, session_ids=[]).count() == 0
    assert {r.session_id for r in archive.scan(back, since="2026-03-02T00:00:00").collect()} == {"b"}
    with pytest.raises(ValueError):
        archive.scan(back, since="not a time")


def test_release_of_three(spark):
    at = [0, 10, 20, 400, 401, 900]
    c = spark.createDataFrame([("s", T0 + timedelta(seconds=x)) for x in at] + [("t", T0)], "sig string, captured_at timestamp")
    got = triggers.released(c, "sig").collect()
    assert [(r.sig, (r.released_at - T0).seconds, r["size"]) for r in got] == [("s", 20, 3)]


def test_payload_forms(spark):
    forms = {'[{"a":1}]': '[{"a":1}]', 'x\n```json\n[1]\n```\ny': "[1]", "```\n{}\n```": "{}", "none": "none", "  [2] ": "[2]"}
    df = spark.createDataFrame([(k,) for k in forms], "reply string")
    assert {r.reply: r.p for r in df.select("reply", distill.payload(F.col("reply")).alias("p")).collect()} == forms


def test_bad_json_is_isolated(spark):
    r = spark.createDataFrame([("a", "[{"), ("b", '[{"title":"t"}]'), ("c", "{}"), ("d", None)], "session_id string, reply string")
    assert [x.session_id for x in distill.candidates(r, distill.ISSUE).filter("title IS NOT NULL").collect()] == ["b"]


def line(**x):
    return json.dumps(x)


def test_transcript(spark, tmp_path):
    rows = [
        line(type="file-history-snapshot"),
        line(type="user", uuid="u1", sessionId="s1", cwd="/w/demo", message={"role": "user", "content": "hi"}, timestamp="2026-03-01T00:00:00Z"),
        line(type="assistant", message={"role": "assistant", "content": [{"type": "text", "text": "yes"}]}, timestamp="2026-03-01T00:00:01Z"),
        line(type="assistant", uuid="u3", message={"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "sh", "input": {"c": "pwd"}}]}),
        line(type="progress", parentToolUseID="t1", data={"type": "p", "output": "half"}),
        line(type="user", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "", "is_error": False}]}, toolUseResult={"stdout": "/w/demo"}),
        '{"type":"assistant","mess',
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(rows))
    found = transcripts.rows(spark, str(tmp_path / "s1.jsonl"))
    m = transcripts.messages(found).orderBy("ord").collect()
    assert [(x.id, x.role, x.content) for x in m] == [("u1", "user", "hi"), ("s1-2", "assistant", "yes"), ("u3", "assistant", None)]
    t = transcripts.tool_calls(found).collect()
    assert [(x.id, x.name, x.output, x.error) for x in t] == [("t1", "sh", "/w/demo", None)]


def test_transcript_with_a_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type":\n{"type":"user"}\n')
    with pytest.raises(Exception, match="not JSON"):
        transcripts.rows(spark, str(tmp_path / "x.jsonl")).collect()

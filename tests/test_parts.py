"""Sources, providers, sinks, buffer, configuration, evaluation and the command line on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from parlance import config, plugins
from parlance.__main__ import main
from parlance.operators import archive, distill, evaluation
from parlance.sources import toolhost, transcripts
from parlance.streaming import triggers as streams

TEXT_PARTS = [{"type": "text", "text": "a"}, {"type": "image"}, "b", {"type": "text", "text": 5}]


def line(type, content, at, uuid=None, **more):
    return json.dumps({"type": type, "uuid": uuid, "timestamp": f"2026-03-10T00:00:0{at}.000Z", "cwd": "/w\\demo", "sessionId": "s1", "gitBranch": "HEAD" if at == 1 else "feature/x", "message": {"role": type, "content": content}, **more})


def test_transcript_payload(spark, tmp_path):
    rows = [
        json.dumps({"type": "file-history-snapshot"}),
        line("user", "[not json] hi", 1, "u1"),
        line("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "one"}, {"type": "text", "text": " "}, {"type": "text", "text": "two"}], 2),
        line("assistant", [{"type": "tool_use", "id": "t1", "name": "run", "input": {"c": "ls"}}], 3, "u3"),
        json.dumps({"type": "progress", "parentToolUseID": "t1", "data": {"output": "half"}}),
        line("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "x"}, "y"], "is_error": True}], 4, "u4", toolUseResult={"stderr": " "}),
        line("system", "note", 5, "u5"),
        line("system", " ", 6, "u6"),
        '{"type": "user", "mess',
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s1.jsonl").write_text("\n".join(rows))
    assert transcripts.session_file(spark, str(tmp_path), "s1").endswith("s1.jsonl")
    with pytest.raises(FileNotFoundError):
        transcripts.session_file(spark, str(tmp_path), "nobody")
    p = transcripts.payloads(transcripts.rows(spark, str(tmp_path / "p" / "s1.jsonl"))).first()
    assert [(m.id, m.role, m.content) for m in p.messages] == [("u1", "user", "[not json] hi"), ("s1-2", "assistant", "one\ntwo"), ("u3", "assistant", None), ("u5", "system", "note")]
    assert [(x.type, x.text) for x in p.messages[1].parts] == [("reasoning", "hm"), ("text", "one"), ("text", "two")]
    tool = p.messages[2].parts[0]
    assert (tool.name, tool.output, tool.error) == ("run", "x\ny", "x\ny") and p.tools[0].message_id == "u3" and p.tools[0].output == "x\ny"
    assert (p.context.repo, p.context.branch, p.session.session_id, p.session.rows) == ("demo", "feature/x", "s1", 8)
    assert p.time_range.start.second == 1 and p.time_range.end.second == 5


def test_toolhost(spark):
    answers = {"/session/a": {"id": "a", "directory": "/x/repo", "time": {"created": 1000.0, "updated": 5000.0}}, "/session/a/message": [{"info": {"id": "m", "role": "user", "time": {"created": 2000.0}}, "parts": [{"type": "text", "text": "t"}, {"type": "file"}, {"type": "tool", "state": {"output": "o"}}, {"type": "step"}]}], "/path": {"directory": "/cwd"}}

    def get(path):
        return answers[path]

    rows = {r.session_id: r for r in toolhost.pulled(spark.createDataFrame([("a",), ("b",)], "session_id string"), get).collect()}
    assert "KeyError" in rows["b"].error and rows["a"].error is None
    parsed = spark.createDataFrame([(rows["a"].response,)], "r string").select(F.from_json("r", toolhost.RESPONSE).alias("r")).select("r.*")
    p = toolhost.payloads(parsed).first()
    assert p.messages[0].content == "t" and [x.type for x in p.messages[0].parts] == ["text", "file", "tool"] and p.messages[0].parts[1].mime == "application/octet-stream"
    assert (p.tools[0].id, p.tools[0].name, p.tools[0].output) == ("m-tool", "unknown", "o") and p.context.repo == "repo" and p.context.cwd == "/cwd"
    assert toolhost.auth_header("k", "u", "p") == {"authorization": "Bearer k"} and toolhost.auth_header(None, "u", "p")["authorization"].startswith("Basic ")


def test_provider_requests():
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    r = plugins.request("openai", messages, "m", {"api_key": "k", "base_url": "http://h/"}, as_json=True)
    assert r["url"] == "http://h/v1/chat/completions" and r["body"]["response_format"] == {"type": "json_object"} and r["headers"]["authorization"] == "Bearer k"
    assert "response_format" not in plugins.request("ollama", messages, "m", as_json=True)["body"]
    r = plugins.request("anthropic", messages, "m", {"api_key": "k"}, temperature=0.3, as_json=True)
    assert r["body"]["system"] == "s\n\nReturn only valid JSON." and r["body"]["max_tokens"] == 4096 and len(r["body"]["messages"]) == 1
    with pytest.raises(plugins.ProviderError):
        plugins.request("deepseek", messages, "m")
    assert plugins.text_of_content(TEXT_PARTS) == "ab"
    assert plugins.reply_of("openai", {"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": 2}}) == {"content": "x", "tokens": {"input": 2, "output": 0}}
    for bad in ({}, {"choices": []}):
        with pytest.raises(plugins.ProviderError):
            plugins.reply_of("openai", bad)
    assert plugins.retry_after_s("Thu, 01 Jan 1970 00:01:00 GMT", 0.0) == 60 and plugins.retry_after_s("2") == 2 and plugins.retry_after_s("soon") is None


def test_routes_and_fallback():
    c = {"llm": {"providers": {"openai": {}, "ollama": {"model": "own"}}}}
    assert plugins.routes(c["llm"], "premium") == [("openai", "gpt-4o"), ("ollama", "own")]
    assert list(plugins.preferred(c, "ollama/big")["llm"]["providers"].items()) == [("ollama", {"model": "big"}), ("openai", {})]
    with pytest.raises(ValueError):
        plugins.preferred(c, "ollama")

    def send(request):
        if "openai" in request["url"]:
            return 429, {"retry-after": "1"}, {}
        return 200, {}, {"choices": [{"message": {"content": "ok"}}]}

    router = plugins.Router([("openai", plugins.completer("openai", {"api_key": "k"}, send)), ("ollama", plugins.completer("ollama", {}, send))])
    assert router("p") == "ok" and router.tried == ["openai", "ollama"]

    def odd(_):
        raise KeyError("x")

    with pytest.raises(ExceptionGroup):
        plugins.Router([("openai", plugins.completer("openai", {"api_key": "k"}, send)), ("odd", odd)])("p")
    with pytest.raises(KeyError):
        plugins.Router([("odd", odd)])("p")


def test_buffer_keeps_the_newest(tmp_path):
    b = plugins.Buffer(str(tmp_path), keep=50)
    for i in range(51):
        os.utime(b.save({"n": i}), ns=(i * 10**9, i * 10**9))
    assert len(b.files()) == 50
    (tmp_path / "0.json").write_text("{")
    os.utime(tmp_path / "0.json", ns=(0, 0))
    sent = []
    assert b.flush(lambda c: sent.append(c["n"]) or c["n"] < 10) == 9 and sent[:3] == [1, 2, 3] and len(b.files()) == 41


def test_file_for_each_result(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r/1", "# m"), ("b", None, None)], "id string, repo string, markdown string")
    assert {r.id: r.error for r in plugins.one_file_each(rows, str(tmp_path)).collect()} == {"a": None, "b": None}
    assert (tmp_path / "r_1" / "pending" / "a.md").read_text() == "# m\n" and json.loads((tmp_path / "_global" / "pending" / "b.json").read_text())["id"] == "b"
    assert not (tmp_path / "_global" / "pending" / "b.md").exists()


def test_config(tmp_path):
    assert config.load(str(tmp_path))["distillers"] == ["pitfall-card"]
    (tmp_path / "parlance_config.py").write_text("config = 1 / 0")
    (tmp_path / "parlance.json").write_text('{"x": 1}')
    assert config.load(str(tmp_path)) == {"x": 1}
    assert config.provider_list(" a, b,,a ") == ["a", "b"] and config.provider_list(" ,") == ["toolhost"]
    t = config.Triggers.merged({"thresholds": {"frequency": {"threshold": 5}}, "enabled": None, "distill": {"enabled": False}})
    assert t.threshold == 5 and t.window_ms == 300_000 and t.enabled and not t.distill and t.severity_keywords[0] == "fatal"


SAMPLES = [{"id": "s", "intent": "bug", "rawInput": "mail a@b.org", "expected": {"primarySignal": "A", "signals": [{"key": "a"}, {"key": "b"}], "issue": {"shouldIssue": True, "title": "Fix the login page", "type": "bug", "priority": "high", "actionability": 0.8}, "actions": [{"key": "x"}, {"key": "y"}], "knowledge": {"shouldDistill": True, "kind": "card", "scope": "repo"}, "redaction": {"mustRedact": ["t1", "t2"], "shouldKeep": ["k"]}}}]
SAID = [{"id": "s", "signals": [{"key": "old"}]}, {"id": "s", "signals": [{"key": "A ", "confidence": 0.9}, {"key": "c", "confidence": 0.2}], "issueDraft": {"shouldIssue": True, "title": "fix login page", "type": "docs", "actionability": 0.6}, "actions": [{"label": "X"}], "knowledge": {"shouldDistill": True, "kind": "card"}, "redaction": {"redacted": ["t1", "k", "z"]}}]


def test_evaluation(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SAMPLES))
    (tmp_path / "p.json").write_text(json.dumps(SAID))
    samples, said = evaluation.load(spark, str(tmp_path / "s.json")), evaluation.load(spark, str(tmp_path / "p.json"), evaluation.PREDICTION)
    m = evaluation.report(evaluation.evaluated(samples, said), "v", "d").first().metrics
    assert (m.signal.precision_, m.signal.recall_, m.signal.false_positive_rate, m.signal.top1_hit_rate) == (0.5, 0.5, 0.5, 1)
    assert (m.issue.title_hit_rate, m.issue.type_accuracy, round(m.issue.actionability_gap, 6)) == (1, 0, 0.2)
    assert (m.action.precision_, m.action.recall_, m.knowledge.type_accuracy) == (1, 0.5, 1)
    assert (m.redaction.leak_rate, round(m.redaction.over_redaction_rate, 6)) == (0.5, round(1 / 3, 6))
    nothing = evaluation.evaluated(samples, said.filter("false")).first()
    assert nothing.issue.should_issue_accuracy == 0 and nothing.signal.recall_ == 0 and nothing.knowledge.type_accuracy == 0
    assert evaluation.report(evaluation.evaluated(samples.filter("false"), said), "v", "d").first().metrics.signal.recall_ is None


def randoms(seed, n):
    """The generator in plain integers."""
    h = 0
    for c in seed:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    x, out = h or 42, []
    for _ in range(n):
        x ^= (x << 13) & 0xFFFFFFFF
        signed = x - 2**32 if x >= 2**31 else x
        x ^= (signed >> 7) & 0xFFFFFFFF
        x ^= (x << 17) & 0xFFFFFFFF
        out.append(x / 0xFFFFFFFF)
    return out


def test_baseline(spark):
    seeds = ["v:1", "", "v:long id 5"]
    got = {r.s: r.r for r in spark.createDataFrame([(s,) for s in seeds], "s string").select("s", evaluation.randoms(F.col("s"), 8).alias("r")).collect()}
    assert all(got[s] == pytest.approx(randoms(s, 8)) for s in seeds)
    samples = spark.createDataFrame([json.dumps({**SAMPLES[0], "id": f"s{i}"}) for i in range(30)], "string").select(F.from_json("value", f"struct<{evaluation._fields(evaluation.SAMPLE)}>").alias("s")).select("s.*")
    rows = evaluation.baseline(samples, "v").collect()
    assert rows == evaluation.baseline(samples, "v").collect()
    for r in rows:
        x = randoms(f"v:{r.id}", 9)
        assert len(r.signals) == (2 if x[0] > 0.12 else 1) + (x[2] < 0.1) and len(r.actions) == (2 if x[1] > 0.18 else 1)
        assert r.issueDraft.shouldIssue == (x[3] >= 0.08) and r.redaction.redacted == [t for t, y in zip(("t1", "t2", "a@b.org"), x[6:], strict=True) if y > 0.15]


def test_distilled_results(spark):
    card = {"problem": "p", "root_cause": "r", "solution": "s", "prevention": "v", "category": "c", "evidence_refs": [{"message_id": "gone", "excerpt": "e"}]}
    replies = spark.createDataFrame([("a", json.dumps([card, card]), None), ("b", "no json", None), ("c", json.dumps([card]), None), ("d", None, "timeout")], "session_id string, reply string, error string")
    messages = spark.createDataFrame([("a", "a-0", "first", 0), ("a", "a-1", "second", 1), ("b", "b-0", "x", 0)], "session_id string, message_id string, text string, turn int")
    results, errors, report = distill.distilled(replies, messages, "pitfall-card")
    r = results.collect()
    assert len(r) == 1 and r[0].evidence[0].excerpt == "first" and r[0].evidence[0].trace_command == "parlance trace --session a --message a-0"
    assert errors.collect()[0].message == "timeout"
    assert report.first().asDict() == {"distiller_id": "pitfall-card", "artifacts_processed": 4, "results_produced": 1, "results_skipped": 1, "errors": 1}
    assert distill.distilled(replies, messages, "pitfall-card", known=results)[0].count() == 0
    drafts = spark.createDataFrame([("a", "t", "", "s", []), ("b", "t", "x", "s", []), ("c", "t", "x", "s", ["e"])], "session_id string, type string, title string, summary string, evidence array<string>")
    good, bad = distill.checked(drafts)
    assert good.count() == 1 and {x.message for x in bad.collect()} == {"missing required draft fields", "evidence is required"}


def test_archive_takes_the_last_write(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS session_id, 'r 1' AS repo, TIMESTAMP '2026-01-01' AS captured_at, 1 AS n")
    archive.write(rows, str(tmp_path))
    archive.write(rows.withColumn("n", F.lit(2)), str(tmp_path))
    assert [(r.repo, r.n) for r in archive.read(spark, str(tmp_path)).collect()] == [("r_1", 2)]


def test_failed_batches_are_kept(spark, tmp_path):
    from parlance.sources.adapters import captures

    one = captures(spark, "/root/testdata/sf0.001").limit(20).withColumns({"batch_key": F.col("trigger"), "trigger_score": F.lit(1), "processing_mode": F.lit("full")})
    one.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))

    def broken(_, epoch):
        raise OSError("full")

    streams.micro_batches(stream, broken, str(tmp_path / "check"), available_now=True).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "check-dead-letters"))
    assert kept.count() == 20 and kept.first().error == "OSError: full"


def test_extractor_hooks(spark):
    seen = []
    e = plugins.define("x", "1", ("card",), str.upper, initialize=lambda: seen.append("on"), teardown=lambda: seen.append("off"))({})
    rows = e.run(spark.createDataFrame([("a", "p")], "session_id string, prompt string"), lambda df: df.collect())
    assert rows[0].reply == "P" and seen == ["on", "off"] and plugins.evidence("s", "m", "e")["excerpt"] == "e"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s1.jsonl").write_text(line("user", "mail a@b.org", 1, "u1"))
    main(["capture", "--transcripts", str(tmp_path / "s1.jsonl"), "--archive", str(tmp_path / "lake")])
    stored = archive.read(spark, str(tmp_path / "lake")).first()
    assert stored.messages[0].content == "mail [EMAIL]" and stored.redacted_total == 1
    card = {"problem": "p", "root_cause": "r", "solution": "s", "prevention": "v", "category": "c"}
    (tmp_path / "r.json").write_text(json.dumps({"session_id": "s1", "reply": json.dumps([card])}))
    main(["distill", "--archive", str(tmp_path / "lake"), "--replies", str(tmp_path / "r.json"), "--out", str(tmp_path / "out"), "--distillers", "pitfall-card"])
    assert spark.read.json(str(tmp_path / "out" / "pitfall-card")).first().title == "p"
    (tmp_path / "s.json").write_text(json.dumps(SAMPLES))
    main(["evaluate", "--samples", str(tmp_path / "s.json"), "--out", str(tmp_path / "report")])
    assert spark.read.json(str(tmp_path / "report")).first().sample_count == 1

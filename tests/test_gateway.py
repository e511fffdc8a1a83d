import json

import pytest

from parlance.operators.gateway import Gateway, gated, parse_ignore
from parlance.plugins import Extractor, ProviderError, Registry, Router, Sink, error_of_status, file_sink, run_sinks

BLOCK = "\n".join(["key sk-abcdefghijklmnopqrstuvwx", "Authorization: Bearer abc.def.ghi", "joe@mail.example.com", "password=hunter2", "https://a.example/?token=xyz&email=a@b.org", "Cookie: sessionid=abc; other=1"])


def test_block():
    g = Gateway()
    out = g.text(BLOCK)
    for part in ("[API_KEY:OPENAI]", "Authorization: [AUTH_HEADER:BEARER]", "[EMAIL]", "password=[PASSWORD]", "token=[TOKEN]", "sessionid=[COOKIE:SESSIONID]"):
        assert part in out, part
    assert sum(g.by_type.values()) >= 8 and g.risk() == "high"
    again = Gateway()
    assert "[PASSWORD]" in again.text(out) and "hunter2" not in again.text(out)


def test_walk_over_json():
    g = Gateway()
    found = json.loads(g.text(json.dumps({"session_id": "s", "password": "p w", "pin": 5, "deep": [{"token": "t", "note": "mail a@b.org"}], "redacted": {"x": "a@b.org"}})))
    assert found["session_id"] == "s" and found["password"] == "[PASSWORD]" and found["pin"] == 5
    assert found["deep"][0]["token"] == "[TOKEN]" and "[EMAIL]" in found["deep"][0]["note"]


def test_ignore():
    assert parse_ignore("/AB/i; [; x") == ("(?i)AB", "x")
    assert Gateway(("sk-",)).text("sk-abcdefghijklmnopqrstuvwx") == "sk-abcdefghijklmnopqrstuvwx"


def test_table(spark):
    df = spark.createDataFrame([(1, BLOCK, "a"), (2, None, "b"), (3, "", "c")], "k long, t string, text string")
    rows = {r.id: r for r in gated(df, "k", "t").collect()}
    assert rows[1].risk_level == "high" and rows[2].text is None and rows[3].total == 0
    assert gated(df.filter("false"), "k", "t").count() == 0


def test_router():
    def fails(kind):
        def call(_):
            raise ProviderError(kind)

        return call

    assert Router([("a", fails("timeout")), ("b", lambda p: p.upper())])("x") == "X"
    with pytest.raises(ProviderError):
        Router([("a", fails("auth")), ("b", str)])("x")
    with pytest.raises(ExceptionGroup):
        Router([("a", fails("timeout")), ("b", fails("rate_limit"))])("x")
    assert [error_of_status(s).kind for s in (401, 429, 504, 500)] == ["auth", "rate_limit", "timeout", "other"]
    assert error_of_status(429, "3").retry_after_s == 3


def test_extractor_and_sinks(spark, tmp_path):
    r = Registry()
    r.add(Extractor("x", "1", ("card",), lambda p: json.dumps([p]) if p != "bad" else 1 / 0))
    with pytest.raises(ValueError):
        r.add(r.known["x"])
    assert r.chosen(["nobody"]) == []
    got = {x.session_id: x for x in r.chosen()[0].replies(spark.createDataFrame([("a", "p"), ("b", "bad")], "session_id string, prompt string")).collect()}
    assert got["a"].reply == '["p"]' and got["b"].reply is None and "ZeroDivision" in got["b"].error
    rows = spark.createDataFrame([("card", "r1", "# m"), ("card", "r2", None), ("other", "r1", None)], "type string, repo string, markdown string")

    def broken(_):
        raise OSError("full")

    report = run_sinks(rows, [file_sink("file", str(tmp_path), ("card",)), Sink("bad", ("other",), broken)])
    assert [(x["sink"], x["delivered"], x["failed"]) for x in report] == [("file", 2, 0), ("bad", 0, 1)]
    assert spark.read.json(str(tmp_path / "results")).count() == 2

from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators import redact


def one(spark, text, ignore=()):
    df = spark.createDataFrame([(text,)], "t string")
    return redact.redacted(df, "t", ignore).first()


def test_block_of_secrets(spark):
    text = "\n".join(["sk-abcdefghijklmnopqrstuvwx", "Authorization: Bearer abc.def.ghi", "joe@mail.example.com", "password=hunter2", "https://a.example/?token=xyz&email=a@b.org", "Cookie: sessionid=abc; other=1"])
    r = one(spark, text)
    for part in ("[API_KEY:OPENAI]", "Authorization: [AUTH_HEADER:BEARER]", "[EMAIL]", "password=[PASSWORD]", "token=[TOKEN]", "sessionid=[COOKIE:SESSIONID]"):
        assert part in r.t, (part, r.t)
    assert r.redaction.risk_level == "high" and r.redaction.by_type["cookie"] == 2 and r.redaction.total >= 10 and r.redaction.by_type["email"] >= 2
    assert "hunter2" not in r.t and "xyz" not in r.t


def test_ignored_text_is_left(spark):
    text = "key sk-abcdefghijklmnopqrstuvwx"
    r = one(spark, text, ("sk-[A-Za-z0-9_-]{20,}",))
    assert r.t == text and r.redaction.total == 0 and r.redaction.by_type == {} and r.redaction.risk_level == "low"


def test_null_and_empty(spark):
    assert one(spark, None).t is None
    assert one(spark, "").t == "" and one(spark, "").redaction.risk_level == "low"


def test_boundaries_are_ascii(spark):
    df = spark.createDataFrame([("é1234567",)], "t string")
    assert df.select(redact.inline(F.col("t"), "phone-inline")[1].alias("n")).first().n == 1


def test_key_rules(spark):
    keys = {"hotel": "[PHONE]", "inside": "[SESSION_ID]", "OPENAI_API_KEY": "[API_KEY:OPENAI]", "id": None, "access_token": "[TOKEN]", "tokens": None, "user": None}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.p for r in df.select("k", C.classify(F.col("k")).alias("p")).collect()} == keys


def test_kv_lines(spark):
    df = spark.createDataFrame([("export OPENAI_API_KEY=abc # x\nplain: text\napi_key: zz",)], "t string")
    text, hits = redact.KV_LINES.apply(F.col("t"))
    r = df.select(text.alias("t"), hits.alias("n")).first()
    assert r.t == "export OPENAI_API_KEY=[API_KEY:OPENAI]\nplain: text\napi_key=[API_KEY]" and r.n == 2


def test_headers_keep_their_spelling(spark):
    assert one(spark, "see x-api-key: v X-AUTH-TOKEN: w").t == "see x-api-key: [AUTH_HEADER:X_API_KEY] X-AUTH-TOKEN: [AUTH_HEADER:X_AUTH_TOKEN]"


def test_risk_by_category(spark):
    assert one(spark, "email=joe").redaction.risk_level == "medium"
    assert one(spark, "see ?token=abcd").redaction.risk_level == "high" and one(spark, "see ?code=abcd").redaction.risk_level == "low"


def test_clashing_columns(spark):
    df = spark.createDataFrame([("email=joe", 1, 2, 3)], "t string, hits int, seen int, row int")
    r = redact.redacted(df, "t").first()
    assert (r.hits, r.seen, r.row) == (1, 2, 3) and r.t == "email=[EMAIL]"


def test_columns_agree_with_the_gateway(spark):
    from parlance.operators.gateway import gated, sanitized

    texts = ["a password=x b", "Cookie: a=1; b; c=2\nexport TOKEN=5 # email=a", '{"token": "t", "n": [1, "a@b.org"]}', "Set-Cookie: k=v; Path=/", "api_key: k1 sk-abcdefghijklmnopqrstuvwx", "plain", "", None, "x-auth-token: q https://h/?password=1&sid=2 +1 743 555-3824"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert sorted(map(tuple, (r.asDict().values() for r in sanitized(df, "k", "t").collect())), key=lambda r: r[0]) == sorted(map(tuple, (r.asDict().values() for r in gated(df, "k", "t").collect())), key=lambda r: r[0])
    assert sanitized(df.filter("false"), "k", "t").count() == 0

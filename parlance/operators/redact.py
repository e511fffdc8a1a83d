"""Redaction of secrets and personal data in a text column, by ordered passes of which each sees what the one before left.

A pass is a pattern, a cheap test that most texts fail, and an expression that says of a match what is put in its place and
which hits (placeholder, category, id) it is. All on the JVM; texts that the test stops are not searched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.functions import patterns as P

HIT = "struct<placeholder:string,category:string,name:string>"
NONE = f"array<{HIT}>"


@dataclass(frozen=True)
class Pass:
    name: str
    gate: Callable[[Column], Column]
    pattern: str
    #: of a match: (what is put in its place, the array of its hits)
    see: Callable[[Column], tuple[Column, Column]]

    def seen(self, text: Column) -> Column:
        """The matches as structs of ``put`` and ``hits``; null where there is nothing to look for."""
        def one(m: Column) -> Column:
            put, hits = self.see(m)
            return F.struct(put.alias("put"), hits.alias("hits"))

        return F.when(self.gate(text), F.transform(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), one))

    def replaced(self, text: Column, seen: Column) -> Column:
        """The gaps and what is put between them."""
        gaps = F.split(text, self.pattern, -1)
        both = F.zip_with(gaps, seen, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m["put"], F.lit(""))))
        return F.when(F.size(seen) > 0, F.array_join(both, "")).otherwise(text)

    def apply(self, text: Column) -> tuple[Column, Column]:
        """(redacted text, number of hits) of one pass alone."""
        seen = self.seen(text)
        return self.replaced(text, seen), F.size(hits_of(seen))


def hits_of(seen: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(seen, lambda m: m["hits"])), F.array().cast(NONE))


def only(hit: Column) -> Column:
    """The hit as an array, none if it is null."""
    return F.when(hit.isNotNull(), F.array(hit)).otherwise(F.array().cast(NONE))


def fixed(placeholder: str, category: str, name: str, put: str | None = None) -> Callable[[Column], tuple[Column, Column]]:
    """Every match is a hit."""
    return lambda m: (F.lit(put or placeholder), F.array(C.hit(F.lit(placeholder), F.lit(category), F.lit(name))))


def has(*words: str) -> Callable[[Column], Column]:
    def gate(text: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    return gate


def finds(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def suffixed(found: Column, by: str) -> Column:
    return F.when(found.isNotNull(), C.hit(found["placeholder"], found["category"], F.concat(found["name"], F.lit(by))))


def named_header(m: Column) -> tuple[Column, Column]:
    """The header's name stays as it was written."""
    name = F.regexp_extract(m, "^([^:]+):", 1)
    placeholder = F.concat(F.lit("[AUTH_HEADER:"), F.upper(F.replace(name, F.lit("-"), F.lit("_"))), F.lit("]"))
    return F.concat(name, F.lit(": "), placeholder), F.array(C.hit(placeholder, F.lit("auth_header"), F.concat(F.lit("auth-header:"), F.lower(name))))


def cookie_header(m: Column) -> tuple[Column, Column]:
    """Each ``name=value``; attributes without a value stay. Each cookie is a hit."""
    head = F.regexp_extract(m, r"(?i)^(Set-Cookie|Cookie):", 1)
    parts = F.split(F.regexp_extract(m, r"(?is)^(?:Set-Cookie|Cookie):\s*(.*)\z", 1), r";\s*", -1)
    is_pair = lambda c: c.rlike(r"(?s)^[^=]*=[^=]")
    name = lambda c: F.substring_index(c, "=", 1)
    placeholder = lambda c: F.concat(F.lit("[COOKIE:"), F.upper(C.trimmed(name(c))), F.lit("]"))
    put = F.transform(parts, lambda c: F.when(is_pair(c), F.concat(name(c), F.lit("="), placeholder(c))).otherwise(c))
    hits = F.transform(F.filter(parts, is_pair), lambda c: C.hit(placeholder(c), F.lit("cookie"), F.concat(F.lit("cookie:"), F.lower(name(c)))))
    return F.concat(head, F.lit(": "), F.array_join(put, "; ")), hits


def json_pair(m: Column) -> tuple[Column, Column]:
    key = F.regexp_extract(m, r'^"([^"]+)"', 1)
    found = C.classified(key)
    return F.when(found.isNotNull(), F.concat(F.lit('"'), key, F.lit('": "'), found["placeholder"], F.lit('"'))).otherwise(m), only(suffixed(found, ":json"))


def kv_line(m: Column) -> tuple[Column, Column]:
    """An assignment that fills a line; what follows the value goes, and the sign becomes ``=``."""
    key = F.regexp_extract(m, P.KV_LINE, 2)
    found = F.when(~F.lower(key).isin("authorization", "cookie"), C.classified(key))
    return F.when(found.isNotNull(), F.concat(F.regexp_extract(m, P.KV_LINE, 1), key, F.lit("="), found["placeholder"])).otherwise(m), only(suffixed(found, ":kv"))


def assignment(m: Column) -> tuple[Column, Column]:
    """``key=value`` within a line; a value in brackets is a placeholder already."""
    key = F.regexp_extract(m, r"^([A-Za-z0-9_.-]+)", 1)
    found = F.when(~m.rlike(r"(?s)^[A-Za-z0-9_.-]+\s*=\s*\[.*\]\z"), C.classified(key))
    return F.when(found.isNotNull(), F.concat(key, F.lit("="), found["placeholder"])).otherwise(m), only(suffixed(found, ":inline"))


def url_param(m: Column) -> tuple[Column, Column]:
    """Sensitive parameters, by what their key says; what the pass before put there counts again."""
    key = F.regexp_extract(m, r"^[?&]([^=]+)=", 1)
    other = C.hit(F.concat(F.lit("[URL_PARAM:"), F.upper(key), F.lit("]")), F.when(F.contains(F.lower(key), F.lit("password")), "password").otherwise("url_param"), F.concat(F.lit("url-param:"), F.lower(key)))
    found = F.coalesce(C.classified(key), other)
    return F.concat(F.substring(m, 1, 1), key, F.lit("="), found["placeholder"]), F.array(found)


AUTH_HEADERS = [
    Pass("auth-bearer", finds("(?i)authorization:"), r"(?i)Authorization:\s*Bearer\s+[^\s]+", fixed("[AUTH_HEADER:BEARER]", "auth_header", "auth-header:bearer", "Authorization: [AUTH_HEADER:BEARER]")),
    Pass("auth-basic", finds("(?i)authorization:"), r"(?i)Authorization:\s*Basic\s+[A-Za-z0-9+/=]+", fixed("[AUTH_HEADER:BASIC]", "auth_header", "auth-header:basic", "Authorization: [AUTH_HEADER:BASIC]")),
    Pass("auth-named", finds("(?i)x-a[pu]"), r"(?i)(X-Api-Key|X-Auth-Token):\s*([^\s]+)", named_header),
]
COOKIES = Pass("cookies", finds("(?i)cookie:"), P.COOKIES, cookie_header)
JSON_PAIRS = Pass("json", has('"'), P.JSON_PAIR, json_pair)
KV_LINES = Pass("kv", lambda t: (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(P.SENSITIVE), P.KV_LINE, kv_line)
ASSIGNMENTS = Pass("inline", lambda t: F.contains(t, F.lit("=")) & t.rlike(P.SENSITIVE), P.java(P.INLINE_ASSIGNMENT), assignment)
URL_PARAMS = Pass("url", lambda t: F.contains(t, F.lit("=")) & t.rlike("[?&]"), P.URL_PARAM, url_param)
#: Cheap tests of the inline patterns, by their ids.
GATES = {"api-key-openai": has("sk-"), "github-token": finds("gh[pousr]_"), "aws-access-key": has("AKIA"), "bearer-inline": finds(r"(?i)bearer\s"), "email-inline": has("@"), "phone-inline": finds(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "sensitive-path": finds(r"(?i)auth|credentials|\.env")}
INLINE = {name: Pass(name, GATES[name], P.java(pattern, fold), fixed(put, category, name)) for name, pattern, fold, put, category in P.INLINE}
#: All passes in their order.
PASSES = [*AUTH_HEADERS, COOKIES, JSON_PAIRS, KV_LINES, ASSIGNMENTS, URL_PARAMS, *INLINE.values()]


def inline(text: Column, name: str) -> tuple[Column, Column]:
    """(redacted text, hits) of one pattern of the table."""
    p = INLINE[name]
    placeholder = next(x[3] for x in P.INLINE if x[0] == name)
    return F.when(p.gate(text), F.regexp_replace(text, p.pattern, placeholder)).otherwise(text), F.when(p.gate(text), F.regexp_count(text, F.lit(p.pattern))).otherwise(0)


def auth_headers(text: Column) -> tuple[Column, Column]:
    hits = F.lit(0)
    for p in AUTH_HEADERS:
        text, n = p.apply(text)
        hits = hits + n
    return text, hits


def risk(counts: dict[str, Column]) -> Column:
    some = lambda names: sum((counts[n] for n in names if n in counts), F.lit(0)) > 0
    return F.when(some(P.HIGH_RISK), "high").when(some(P.MEDIUM_RISK), "medium").otherwise("low")


def risk_of(categories: Column) -> Column:
    some = lambda names: F.arrays_overlap(categories, F.array(*map(F.lit, names)))
    return F.when(some(P.HIGH_RISK), "high").when(some(P.MEDIUM_RISK), "medium").otherwise("low")


def with_hits(df: DataFrame, col: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (the columns of the table), ``t`` (the redacted text; null stays null) and ``hits`` of all passes in their order.

    A text that one of the ``ignore`` patterns finds is left as it is. One projection for each pass, so that no pass is
    computed twice; nothing is shuffled.
    """
    text, skip = df[f"`{col}`"], F.lit(False)
    for p in ignore:
        skip = skip | text.rlike(p)
    own = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")
    out = df.select(own, text.alias("t"), F.coalesce(skip, F.lit(False)).alias("skip"), F.array().cast(NONE).alias("hits"))
    for p in PASSES:
        out = out.withColumn("seen", F.when(~F.col("skip"), p.seen(F.col("t"))))
        found = F.size("seen") > 0
        out = out.select("row", p.replaced(F.col("t"), F.col("seen")).alias("t"), "skip", F.when(found, F.concat("hits", hits_of(F.col("seen")))).otherwise(F.col("hits")).alias("hits"))
    return out.select("row", "t", "hits")


def summary(hits: Column) -> Column:
    """total, by_type, by_placeholder, patterns and risk_level of an array of hits."""
    part = lambda name: F.transform(hits, lambda h: h[name])
    return F.struct(F.size(hits).cast("long").alias("total"), C.tally(part("category")).alias("by_type"), C.tally(part("placeholder")).alias("by_placeholder"), F.array_sort(F.array_distinct(part("name"))).alias("patterns"), risk_of(part("category")).alias("risk_level"))


def redacted(df: DataFrame, col: str, ignore: tuple[str, ...] = (), into: str = "redaction") -> DataFrame:
    """The table with the text redacted by all passes, and their summary as one more column ``into`` (which replaces a column of that name)."""
    out = with_hits(df, col, ignore)
    out = out.select(F.struct("row", "t", summary(F.col("hits")).alias("summary")).alias("found"))
    kept = [F.col("found.t").alias(c) if c == col else F.col("found.row").getField(c).alias(c) for c in df.columns if c != into]
    return out.select(*kept, F.col("found.summary").alias(into))

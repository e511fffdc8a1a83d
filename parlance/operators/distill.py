"""What comes before and after extraction: prompts, JSON payloads, validity, evidence, ranking, rendering, fingerprints.

The extractor itself is a function given by the caller (text in, JSON text out); ``parlance.plugins`` runs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions import columns as C
from parlance.functions import patterns as P

MOST_CHARS = 1200
FENCE = "```"


def prompts(messages: DataFrame) -> DataFrame:
    """session_id and prompt: each message's first characters in the order of turns."""
    line = F.concat(F.lit("["), F.col("message_id"), F.lit("] ("), F.col("role"), F.lit(") "), F.substring(F.coalesce("text", F.lit("")), 1, MOST_CHARS))
    by = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return by.select("session_id", F.concat(F.lit("session_id: "), F.col("session_id"), F.lit("\nmessages:\n"), F.array_join(F.transform("x", lambda m: m["line"]), "\n")).alias("prompt"))


def payload(reply: Column) -> Column:
    """The JSON of a reply: itself, or the first fenced block, or the reply as it is."""
    t = C.trimmed(reply)
    body = F.regexp_extract(t, rf"(?is){FENCE}(?:json)?\s*(.*?){FENCE}", 1)
    return F.when(t.rlike(r"^[\[{]"), t).when(t.rlike(rf"(?is){FENCE}(?:json)?\s*(.*?){FENCE}"), C.trimmed(body)).otherwise(t)


ISSUE = "array<struct<title:string,summary:string,background:string,problem:string,proposed_solution:string,acceptance_criteria:array<string>,confidence:double,issue_kind:string,labels:array<string>,evidence_refs:array<struct<message_id:string,excerpt:string>>>>"
PITFALL = "array<struct<problem:string,root_cause:string,solution:string,prevention:string,category:string,language:string,confidence:double,evidence_refs:array<struct<message_id:string,excerpt:string>>>>"


def candidates(replies: DataFrame, kind: str) -> DataFrame:
    """One row for each candidate of a reply, numbered; what cannot be parsed gives none, session by session (and never ends the run)."""
    return replies.select("session_id", F.posexplode(F.from_json(payload(F.col("reply")), kind, {"mode": "PERMISSIVE"})).alias("ord", "c")).select("session_id", "ord", "c.*")


def issue_kind(kind: Column) -> Column:
    return F.when(kind.isin(*P.ISSUE_KINDS), kind)


def labels(found: Column) -> Column:
    out = F.array_distinct(F.filter(F.transform(found, C.trimmed), lambda x: x != ""))
    return F.when(F.size(out) > 0, out)


def valid_issues(rows: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in ("title", "summary", "background", "problem", "proposed_solution"):
        ok = ok & (C.trimmed(F.coalesce(F.col(c), F.lit(""))) != "")
    return rows.filter(ok & F.col("acceptance_criteria").isNotNull() & F.forall("acceptance_criteria", lambda x: x.isNotNull()))


def evidence(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, ord, evidence): references to messages of the session, the first of each message and excerpt; others are dropped."""
    refs = rows.select("session_id", "ord", F.posexplode("evidence_refs").alias("at", "r")).select("session_id", "ord", "at", "r.*")
    known = messages.select("session_id", "message_id").distinct()
    held = refs.join(known, ["session_id", "message_id"])
    first = held.groupBy("session_id", "ord", "message_id", "excerpt").agg(F.min("at").alias("at"))
    return first.groupBy("session_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "message_id", "excerpt"))), lambda x: F.struct(x["message_id"].alias("message_id"), x["excerpt"].alias("excerpt"))).alias("evidence"))


def best_issue(rows: DataFrame) -> DataFrame:
    """Of each session the candidate of most confidence (0.5 if none is said), then most evidence, then the least title."""
    w = Window.partitionBy("session_id").orderBy(F.coalesce("confidence", F.lit(0.5)).desc(), F.size("evidence").desc(), C.trimmed(F.col("title")), "ord")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def issue_tags(kind: Column, found: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("issue-draft")), F.when(issue_kind(kind).isNotNull(), F.array(kind)).otherwise(F.array().cast("array<string>")), F.coalesce(labels(found), F.array().cast("array<string>"))))


def issue_markdown() -> Column:
    bullets = F.array_join(F.transform("acceptance_criteria", lambda x: F.concat(F.lit("- "), x)), "\n")
    proof = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- `"), e["message_id"], F.lit("`: "), e["excerpt"])), "\n")
    head = [F.concat(F.lit("Type: "), issue_kind(F.col("issue_kind"))), F.concat(F.lit("Labels: "), F.array_join(labels(F.col("labels")), ", "))]
    body = [F.lit("## Background"), F.col("background"), F.lit(""), F.lit("## Problem"), F.col("problem"), F.lit(""), F.lit("## Proposed Solution"), F.col("proposed_solution"), F.lit(""), F.lit("## Acceptance Criteria"), bullets, F.lit(""), F.lit("## Evidence"), proof]
    return F.array_join(F.filter(F.array(*head, *body), lambda x: x.isNotNull()), "\n")


def pitfalls(rows: DataFrame) -> DataFrame:
    """Cards: title of 80 characters, summary, confidence (0.7 if none is said) and tags."""
    ok = F.lit(True)
    for c in ("problem", "root_cause", "solution", "prevention", "category"):
        ok = ok & F.col(c).isNotNull()
    return rows.filter(ok).withColumns({"title": F.substring("problem", 1, 80), "summary_line": F.concat("problem", F.lit(" -> "), "solution"), "confidence": F.coalesce("confidence", F.lit(0.7)), "tags": F.array(F.lit("pitfall"), F.col("category"))})


def fingerprint(distiller: str, session: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(distiller), session, body), 256)


def first_of_fingerprint(rows: DataFrame, known: DataFrame | None, order: str) -> DataFrame:
    """Results whose fingerprint is new: not among the known ones, and the first of this run."""
    out = rows if known is None else rows.join(known.select("fingerprint"), "fingerprint", "left_anti")
    least = out.groupBy("fingerprint").agg(F.min(order).alias(order))
    return out.join(least, ["fingerprint", order])


def with_fallback(cards: DataFrame, found: DataFrame, messages: DataFrame) -> DataFrame:
    """Cards with ``evidence``: the references that hold, else the session's first message (its text, or the problem); cards of
    sessions without messages go."""
    first = messages.groupBy("session_id").agg(F.min_by(F.struct("message_id", "text"), "turn").alias("m"))
    joined = cards.join(found, ["session_id", "ord"], "left").join(first, "session_id")
    instead = F.array(F.struct(F.col("m.message_id").alias("message_id"), F.coalesce("m.text", "problem").alias("excerpt")))
    return joined.withColumn("evidence", F.coalesce("evidence", instead)).drop("m")


def trace_command(session: Column, message: Column, program: str = "parlance") -> Column:
    """How to look a piece of evidence up."""
    return F.concat(F.lit(f"{program} trace --session "), session, F.lit(" --message "), message)


def checked(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, errors): drafts with a type, title, summary and evidence; of the others session_id and message."""
    there = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    fields = there("type") & there("title") & there("summary")
    proof = F.coalesce(F.size("evidence"), F.lit(0)) > 0
    bad = drafts.filter(~(fields & proof)).select("session_id", F.when(~fields, "missing required draft fields").otherwise("evidence is required").alias("message"))
    return drafts.filter(fields & proof), bad


def result_id(print_: Column) -> Column:
    """An id made of the fingerprint, so that runs repeat."""
    return F.concat_ws("-", *[F.substring(print_, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def finished(drafts: DataFrame, distiller: str, version: str, payload_cols: list[str], program: str = "parlance") -> DataFrame:
    """Results: the drafts with payload, fingerprint, id, distiller and a trace command for each piece of evidence. The
    fingerprint's session is that of the evidence."""
    body = F.to_json(F.struct(*payload_cols))
    out = drafts.withColumn("payload", body).withColumn("fingerprint", fingerprint(distiller, F.col("session_id"), F.col("payload")))
    proof = F.transform("evidence", lambda e: F.struct(F.col("session_id").alias("session_id"), e["message_id"].alias("message_id"), e["excerpt"].alias("excerpt"), trace_command(F.col("session_id"), e["message_id"], program).alias("trace_command")))
    keep = [c for c in ("ord", "markdown", "repo") if c in drafts.columns]
    return out.select(result_id(F.col("fingerprint")).alias("id"), "fingerprint", F.lit(distiller).alias("distiller_id"), F.lit(version).alias("distiller_version"), "session_id", "type", "title", "summary", "confidence", "tags", "payload", proof.alias("evidence"), *keep)


def issue_drafts(replies: DataFrame, messages: DataFrame) -> DataFrame:
    """Of each session the best issue, as a draft."""
    found = valid_issues(candidates(replies, ISSUE))
    best = best_issue(found.join(evidence(found, messages), ["session_id", "ord"]))
    return best.select("*", F.lit("issue-draft").alias("type"), F.coalesce("confidence", F.lit(0.7)).alias("sure"), issue_tags(F.col("issue_kind"), F.col("labels")).alias("tags"), issue_markdown().alias("markdown")).drop("confidence").withColumnRenamed("sure", "confidence")


def pitfall_drafts(replies: DataFrame, messages: DataFrame) -> DataFrame:
    """All pitfall cards, as drafts."""
    rows = candidates(replies, PITFALL)
    cards = with_fallback(pitfalls(rows), evidence(rows, messages), messages)
    return cards.withColumns({"type": F.lit("pitfall-card"), "summary": F.col("summary_line")}).drop("summary_line")


#: Built-in distillers: their drafts, and the columns of their payloads in order.
BUILT_IN = {
    "issue-draft": (issue_drafts, ["title", "summary", "background", "problem", "proposed_solution", "acceptance_criteria", "issue_kind", "labels"]),
    "pitfall-card": (pitfall_drafts, ["problem", "root_cause", "solution", "prevention", "category", "language"]),
}


def distilled(replies: DataFrame, messages: DataFrame, distiller: str, version: str = "0.1.0", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, errors, report) of one distiller's replies (session_id, reply, error): drafts, their check, fingerprints, the new ones.

    The report is one row: sessions processed, results produced and skipped as known or repeated, errors.
    """
    draft, payload_cols = BUILT_IN[distiller]
    good, bad = checked(draft(replies, messages))
    all_results = finished(good, distiller, version, payload_cols)
    results = first_of_fingerprint(all_results, known, "session_id").dropDuplicates(["fingerprint"])
    if "error" in replies.columns:
        bad = bad.unionByName(replies.filter(F.col("error").isNotNull()).select("session_id", F.col("error").alias("message")))
    n = replies.agg(F.count_distinct("session_id").alias("artifacts_processed"))
    made = results.agg(F.count("*").alias("results_produced"))
    whole = all_results.agg(F.count("*").alias("drafts"))
    wrong = bad.agg(F.count("*").alias("errors"))
    # four single rows side by side
    report = n.join(made, F.lit(True)).join(whole, F.lit(True)).join(wrong, F.lit(True))
    return results, bad, report.select(F.lit(distiller).alias("distiller_id"), "artifacts_processed", "results_produced", (F.col("drafts") - F.col("results_produced")).alias("results_skipped"), "errors")

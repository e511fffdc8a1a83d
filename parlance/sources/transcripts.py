"""Transcripts: lines of JSON to messages and tool calls with their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.columns import basename, trimmed

#: How the source of these files is named, and messages of sessions without an id.
SOURCE, NAMELESS = "claude-code", "claude"

ITEM = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
ROW = f"type string, uuid string, timestamp string, cwd string, sessionId string, gitBranch string, toolUseID string, parentToolUseID string, message struct<role:string,content:string>, data struct<type:string,output:string,fullOutput:string>, toolUseResult struct<stdout:string,stderr:string>"


def rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of each file, in order. A last line that is cut off is left out; another bad line fails the file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.split("value", r"\r?\n", -1).alias("lines"))
    lines = files.select("file", "mtime", F.posexplode("lines").alias("ord", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    last = Window.partitionBy("file")
    parsed = lines.withColumns({"j": F.try_parse_json("line"), "end": F.max("ord").over(last)})
    cut = (F.col("ord") == F.col("end")) & ~F.col("line").rlike(r"[\]}]\z")
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.col("file"), F.lit(" line "), F.col("ord")))
    checked = parsed.withColumn("line", F.when(F.col("j").isNotNull(), F.col("line")).when(~cut, bad))
    kind = F.schema_of_variant(F.try_variant_get("j", "$.message.content", "variant"))
    return checked.filter(F.startswith("line", F.lit("{"))).select("file", "mtime", "ord", kind.alias("kind"), F.from_json("line", ROW).alias("r")).select("file", "mtime", "ord", "kind", "r.*")


def blank(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))) == ""


def said(value: Column, kind: Column) -> Column:
    """Any JSON value as text: a string as it is; of an array its strings and the texts of its objects, line by line; else the JSON."""
    inner = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), x)).otherwise(x)
    parts = F.filter(F.transform(F.from_json(value, "array<string>"), inner), lambda x: x != "")
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "\n")).otherwise(value)


PART = "struct<type:string,text:string,id:string,name:string,input:string>"


def messages(found: DataFrame) -> DataFrame:
    """User, assistant and system messages in order, with their parts; results of tools alone make no message.

    A message without an id of its own gets the session's (of the rows so far, else ``NAMELESS``) and its number.
    """
    items = F.filter(F.from_json(F.col("message.content"), ITEM), lambda i: i["type"].isNotNull())
    listed = F.startswith(F.coalesce("kind", F.lit("VOID")), F.lit("ARRAY"))
    items = F.when(listed, items).otherwise(F.array().cast(ITEM))
    part = lambda kind, text, i: F.struct(F.lit(kind).alias("type"), text.alias("text"), i["id"].alias("id"), i["name"].alias("name"), i["input"].alias("input"))
    texts = F.filter(items, lambda i: (i["type"] == "text") & ~blank(i["text"]))
    thought = lambda i: F.coalesce(i["thinking"], i["text"])
    keep = lambda i: ((i["type"] == "text") & ~blank(i["text"])) | ((i["type"] == "thinking") & ~blank(thought(i))) | (i["type"] == "tool_use")
    none = F.lit(None).cast("string")
    parts = F.transform(F.filter(items, keep), lambda i: F.when(i["type"] == "text", part("text", i["text"], i)).when(i["type"] == "thinking", part("reasoning", thought(i), i)).otherwise(part("tool", none, i)))
    joined = F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda i: i["text"]), "\n"))
    results = F.exists(items, lambda i: i["type"] == "tool_result")
    whole = said(F.col("message.content"), F.coalesce("kind", F.lit("VOID")))
    is_text = F.col("kind") == "STRING"
    user = F.when(is_text, F.col("message.content")).when(joined.isNotNull(), joined).when(~results & ~blank(whole), whole)
    content = F.when(F.col("type") == "assistant", joined).when(F.col("type") == "user", user).when((F.col("type") == "system") & ~blank(whole), whole)
    out = found.filter(F.col("type").isin("user", "assistant", "system"))
    out = out.withColumns({"content": content, "parts": F.when(F.col("type") == "assistant", parts).otherwise(F.array().cast(f"array<{PART}>"))})
    # the running session id needs the rows that make no message too, so it is looked up among all rows
    so_far = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ids = found.select("file", "ord", F.first("sessionId", ignorenulls=True).over(so_far).alias("sid"))
    out = out.filter(F.col("content").isNotNull() | (F.size("parts") > 0)).join(ids, ["file", "ord"])
    n = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    name = F.coalesce("uuid", F.concat(F.coalesce("sid", F.lit(NAMELESS)), F.lit("-"), n))
    return out.select("file", "ord", name.alias("id"), F.col("type").alias("role"), F.coalesce(F.try_to_timestamp("timestamp"), F.col("mtime")).alias("timestamp"), "content", "parts")


def tool_calls(found: DataFrame) -> DataFrame:
    """Each tool call with the last output that came after it; an error once said stays."""
    items = F.from_json(F.col("message.content"), ITEM)
    spread = found.select("file", "ord", "type", F.explode(items).alias("i"), F.col("toolUseResult.stdout").alias("stdout"), F.col("toolUseResult.stderr").alias("stderr"))
    calls = spread.filter("type = 'assistant' AND i.type = 'tool_use'").select("file", F.col("ord").alias("used_at"), F.col("i.id").alias("id"), F.col("i.name").alias("name"), F.col("i.input").alias("input"))
    inner = said(F.col("i.content"), F.when(F.startswith(F.trim("i.content"), F.lit("[")), "ARRAY").otherwise("STRING"))
    body = F.when(~blank(inner), inner).otherwise(F.col("stdout"))
    error = F.when(F.coalesce(F.col("i.is_error"), F.lit(False)), F.when(~blank(F.col("stderr")), F.col("stderr")).when(~blank(body), body).otherwise("tool result error"))
    results = spread.filter("type = 'user' AND i.type = 'tool_result'").select("file", "ord", F.col("i.tool_use_id").alias("id"), body.alias("output"), error.alias("error"))
    progress = found.filter("type = 'progress'").select("file", "ord", F.coalesce("parentToolUseID", "toolUseID").alias("id"), F.coalesce("data.fullOutput", "data.output").alias("output"), F.lit(None).cast("string").alias("error"))
    both = results.unionByName(progress).withColumn("output", F.when(~blank(F.col("output")), F.col("output")))
    joined = calls.join(both, ["file", "id"], "left").filter(F.col("ord").isNull() | (F.col("ord") > F.col("used_at")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    found = joined.groupBy("file", "id").agg(last("output"), last("error"))
    return calls.join(found, ["file", "id"], "left")


def payloads(found: DataFrame) -> DataFrame:
    """One row for each file: session, messages, tools, context and time range, as a snapshot is built of.

    The context is the first of each kind: working folder, and the branch that is not a detached head; the repository is the
    folder's last part. A file's messages are one row, as a session is.
    """
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("ord"))
    named = F.when(~F.coalesce(F.col("gitBranch"), F.lit("")).isin("", "HEAD"), F.col("ord"))
    head = found.groupBy("file").agg(F.max("mtime").alias("mtime"), F.count("*").alias("rows"), F.min_by("cwd", when("cwd")).alias("cwd"), F.min_by("sessionId", when("sessionId")).alias("sid"), F.min_by("gitBranch", named).alias("branch"))
    calls = tool_calls(found)
    m = messages(found)
    # what a tool part shows is its call's result
    results = F.map_from_entries(F.collect_list(F.struct("id", F.struct("output", "error"))))
    first = calls.groupBy("file", "id").agg(F.first("output").alias("output"), F.first("error").alias("error")).groupBy("file").agg(results.alias("results"))
    known = lambda p, c: F.element_at(F.coalesce("results", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<output:string,error:string>>"))), p["id"])[c]
    part = lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["name"].alias("name"), p["input"].alias("input"), known(p, "output").alias("output"), known(p, "error").alias("error"))
    m = m.join(first, "file", "left").withColumn("parts", F.transform("parts", part)).drop("results")
    made = m.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "role", "timestamp", "content", "parts"))).alias("m"))
    by_row = m.select("file", "ord", F.col("id").alias("message_id"))
    tools = calls.join(by_row, (calls["file"] == by_row["file"]) & (calls["used_at"] == by_row["ord"]), "left").select(calls["file"], "used_at", "id", "message_id", "name", "input", "output", "error")
    tools = tools.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("used_at", "id", "message_id", "name", "input", "output", "error"))).alias("t"))
    out = head.join(made, "file", "left").join(tools, "file", "left")
    fallback = F.regexp_extract("file", r"([^/]*?)(?:\.jsonl)?\z", 1)
    context = F.struct("cwd", F.col("cwd").alias("worktree"), basename(F.col("cwd")).alias("repo"), "branch")
    times = F.struct(F.coalesce(F.get("m", F.lit(0))["timestamp"], "mtime").alias("start"), F.coalesce(F.when(F.size("m") > 0, F.element_at("m", -1)["timestamp"]), "mtime").alias("end"))
    flat = lambda c, drop: F.transform(c, lambda x: x.dropFields(drop))
    session = F.struct(F.lit(SOURCE).alias("source"), F.coalesce("sid", fallback).alias("session_id"), F.col("file").alias("session_file"), "rows")
    return out.select(session.alias("session"), F.coalesce(flat("m", "ord"), F.array()).alias("messages"), flat("t", "used_at").alias("tools"), context.alias("context"), times.alias("time_range"))


def session_file(spark: SparkSession, projects: str, session_id: str) -> str:
    """The file of a session, ``<projects>/*/<session_id>.jsonl``; the first by name. Looked up by Spark's reader, so in any store."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{session_id}.jsonl").load(f"{projects}/*").select("path").orderBy("path").first()
    if found is None:
        raise FileNotFoundError(f"no transcript of session {session_id} under {projects}")
    return found[0]


def latest_results(use: DataFrame, result: DataFrame, key: str, use_id: str, used_at: str, at: str, tie: str, value: str, within_s: int) -> DataFrame:
    """For each use the last result of its key that came after it, within a time.

    The join is on the key and a time bucket as long as the window (a use looks in its own bucket and the next), so rows of
    one busy key meet only those of their time.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (within_s * 1_000_000)).cast("long")
    left = use.withColumn("__b", F.explode(F.array(bucket(used_at), bucket(used_at) + 1)))
    right = result.withColumn("__b", bucket(at))
    late = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(used_at).cast("timestamp"))
    met = left.join(right, [key, "__b"]).filter((late > 0) & (late <= within_s * 1_000_000))
    best = met.groupBy(use_id).agg(F.max_by(value, F.struct(at, tie)).alias("output"))
    return use.select(use_id).join(best, use_id, "left")

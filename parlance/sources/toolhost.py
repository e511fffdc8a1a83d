"""Sessions of a tool host: what its four endpoints say of a session, as the payload that a snapshot is built of.

``pull`` makes the requests through a function the caller gives (path to parsed JSON), ``pulled`` does so for a table of
session ids in Arrow batches; ``payloads`` maps landed responses on the JVM.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.columns import basename

STATE = "struct<input:string,output:string,error:string>"
RESPONSE = f"session struct<id:string,directory:string,time:struct<created:double,updated:double>>, messages array<struct<info:struct<id:string,role:string,time:struct<created:double>>,parts:array<struct<type:string,text:string,mime:string,filename:string,tool:string,callID:string,state:{STATE}>>>>, path struct<directory:string,worktree:string>, vcs struct<branch:string>"


def auth_header(token: str | None = None, user: str | None = None, password: str | None = None) -> dict[str, str]:
    """A bearer token, or else a name and password."""
    if token:
        return {"authorization": f"Bearer {token}"}
    if password:
        return {"authorization": "Basic " + base64.b64encode(f"{user or ''}:{password}".encode()).decode()}
    return {}


def pull(session_id: str, get: Callable[[str], object]) -> dict:
    """The session and its messages; the folder and the branch where the host tells them."""
    out = {"session": get(f"/session/{session_id}"), "messages": get(f"/session/{session_id}/message")}
    for name in ("path", "vcs"):
        try:
            out[name] = get(f"/{name}")
        except Exception:
            out[name] = None
    return out


def pulled(ids: DataFrame, get: Callable[[str], object]) -> DataFrame:
    """session_id, response (JSON) and error of each id; a failure costs its session only."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str | None, str | None]] = []
            for i in b.column(0).to_pylist():
                try:
                    out.append((json.dumps(pull(i, get)), None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["session_id", "response", "error"])

    return ids.select("session_id").mapInArrow(rows, "session_id string, response string, error string")


def mapped(part: Column) -> Column:
    """One part in the snapshot's form, null for kinds it does not know."""
    text = F.lit(None).cast("string")
    form = lambda kind, **have: F.struct(F.lit(kind).alias("type"), *[have.get(c, text).alias(c) for c in ("text", "mime", "filename", "name", "input", "output", "error")])
    state = part["state"]
    out = F.when(part["type"].isin("text") & part["text"].isNotNull(), form("text", text=part["text"]))
    out = out.when((part["type"] == "reasoning") & part["text"].isNotNull(), form("reasoning", text=part["text"]))
    out = out.when(part["type"] == "file", form("file", mime=F.coalesce(part["mime"], F.lit("application/octet-stream")), filename=part["filename"]))
    return out.when(part["type"] == "tool", form("tool", name=F.coalesce(part["tool"], F.lit("unknown")), input=F.coalesce(state["input"], F.lit("{}")), output=state["output"], error=state["error"]))


def payloads(responses: DataFrame, now: Column | None = None) -> DataFrame:
    """session_id, messages, tools, context and time range of each response (a row of RESPONSE); messages without a time get ``now``."""
    at = lambda m: F.when(F.coalesce(m["info"]["time"]["created"], F.lit(0.0)) > 0, F.timestamp_millis(m["info"]["time"]["created"].cast("long"))).otherwise(now if now is not None else F.current_timestamp())
    texts = lambda m: F.transform(F.filter(m["parts"], lambda p: p["type"].isin("text", "reasoning") & p["text"].isNotNull()), lambda p: p["text"])
    message = lambda m: F.struct(m["info"]["id"].alias("id"), m["info"]["role"].alias("role"), at(m).alias("timestamp"), F.when(F.size(texts(m)) > 0, F.array_join(texts(m), "\n")).alias("content"), F.filter(F.transform(m["parts"], mapped), lambda p: p.isNotNull()).alias("parts"))
    call = lambda m: F.transform(F.filter(m["parts"], lambda p: p["type"] == "tool"), lambda p: F.struct(F.coalesce(p["callID"], F.concat(m["info"]["id"], F.lit("-tool"))).alias("id"), m["info"]["id"].alias("message_id"), F.coalesce(p["tool"], F.lit("unknown")).alias("name"), F.coalesce(p["state"]["input"], F.lit("{}")).alias("input"), p["state"]["output"].alias("output"), p["state"]["error"].alias("error")))
    context = F.struct(F.col("path.directory").alias("cwd"), F.col("path.worktree").alias("worktree"), basename(F.coalesce("session.directory", "path.directory")).alias("repo"), F.col("vcs.branch").alias("branch"))
    out = responses.select(F.col("session.id").alias("session_id"), F.transform("messages", message).alias("messages"), F.flatten(F.transform("messages", call)).alias("tools"), context.alias("context"), F.col("session.time").alias("t"))
    said = lambda c: F.when(F.coalesce(c, F.lit(0.0)) > 0, F.timestamp_millis(c.cast("long")))
    else_ = now if now is not None else F.current_timestamp()
    start = F.coalesce(said(F.col("t.created")), F.get("messages", F.lit(0))["timestamp"], else_)
    end = F.coalesce(said(F.col("t.updated")), F.when(F.size("messages") > 0, F.element_at("messages", -1)["timestamp"]), else_)
    return out.withColumn("time_range", F.struct(start.alias("start"), end.alias("end"))).drop("t")

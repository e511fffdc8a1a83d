"""The session archive: scans with time, repository and session filters, incremental reads, the partitioned lake."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.columns import file_stamp, safe_name
from parlance.operators.redact import redacted

GLOBAL = "_global"


def write(sessions: DataFrame, path: str) -> None:
    """Append to the lake, one folder for each repository; ``read`` takes the last of what was written under one key."""
    named = sessions.withColumn("written_at", F.current_timestamp())
    named = named.withColumn("repo", safe_name(F.coalesce("repo", F.lit(GLOBAL))))
    named.withColumn("snapshot", F.concat(file_stamp(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.lit("-"), safe_name(F.col("session_id")))).write.mode("append").partitionBy("repo").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lake, of each snapshot key (repository, time and session) what was written last."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("repo", "snapshot")]
    return rows.groupBy("repo", "snapshot").agg(F.max_by(F.struct(*rest), "written_at").alias("r")).select("r.*", "repo").drop("written_at")


def scan(sessions: DataFrame, repo: str | None = None, since: str | datetime | None = None, until: str | datetime | None = None, session_ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Sessions of a repository and of the global folder, both time bounds inclusive. An empty list of ids means no rows.

    Filters are on stored columns, so that partitions and row groups are pruned before anything is computed.
    """
    out = sessions
    if repo is not None:
        out = out.filter(F.col("repo").isin(repo, GLOBAL))
    for bound, keep in ((since, F.col("captured_at").__ge__), (until, F.col("captured_at").__le__)):
        if bound is not None:
            at = bound if isinstance(bound, datetime) else datetime.fromisoformat(bound)
            out = out.filter(keep(F.lit(at)))
    if isinstance(session_ids, DataFrame):
        out = out.join(session_ids.select("session_id"), "session_id", "left_semi")
    elif session_ids is not None:
        out = out.filter(F.col("session_id").isin(*session_ids)) if session_ids else out.filter(F.lit(False))
    return out


def unprocessed(sessions: DataFrame, processed: DataFrame, distiller: str, limit: int | None = None) -> DataFrame:
    """Sessions that a distiller has not seen; with a limit the first in the order of the archive."""
    seen = processed.filter(F.col("distiller_id") == distiller).select("session_id")
    out = sessions.join(seen, "session_id", "left_anti")
    return out.orderBy("repo", "captured_at", "session_id").limit(limit) if limit is not None else out


def mark_processed(spark: SparkSession, sessions: DataFrame, distiller: str, path: str) -> None:
    """Append to the state table. A session once marked stays so, whatever newer snapshots bring."""
    sessions.select("session_id").distinct().select(F.lit(distiller).alias("distiller_id"), "session_id", F.current_timestamp().alias("processed_at")).write.mode("append").parquet(path)


def artifacts(sessions: DataFrame) -> DataFrame:
    """The form that distillers read: parts without what their type needs are left out (messages without parts stay as they are)."""
    if "parts" not in sessions.schema["messages"].dataType.elementType.names:
        return sessions
    known = sessions.schema["messages"].dataType.elementType["parts"].dataType.elementType.names
    there = lambda p, c: p[c].isNotNull() if c in known else F.lit(False)
    ok = lambda p: (p["type"].isin("text", "reasoning") & there(p, "text")) | ((p["type"] == "tool") & there(p, "name")) | ((p["type"] == "file") & there(p, "filename") & there(p, "mime"))
    return sessions.withColumn("messages", F.transform("messages", lambda m: m.withField("parts", F.filter(m["parts"], ok))))


def valid_captures(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): all four strings there and not empty, and a time that can be read."""
    ok = F.lit(True)
    for c in ("session_id", "trigger", "provider"):
        ok = ok & (F.coalesce(F.length(c), F.lit(0)) > 0)
    ok = ok & F.col("captured_at").isNotNull()
    return captures.filter(ok), captures.filter(~ok)


def built(sessions: DataFrame) -> DataFrame:
    """Snapshots: version, defaults, time range from the first and last message, counters of redaction at zero."""
    first, last = F.get("messages", F.lit(0)), F.element_at("messages", -1)
    return sessions.select("session_id", "provider", "captured_at", F.lit("1.0").alias("schema_version"), F.lit("0.1.0").alias("version"), F.lit("").alias("cwd"), first["id"].alias("first_id"), last["id"].alias("last_id"), F.size("messages").cast("long").alias("n_messages"), F.lit(0).cast("long").alias("redacted_total"))


def routed(captures: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(with a payload already, to be pulled, rejected): captures that bring ``pulled`` need no provider; the others one that is known.

    ``providers`` (provider, ...) is a table of a few rows and is broadcast.
    """
    have = captures.filter(F.col("pulled").isNotNull())
    bare = captures.filter(F.col("pulled").isNull())
    known = F.broadcast(providers.select("provider").distinct())
    rejected = bare.join(known, "provider", "left_anti").withColumn("error", F.concat(F.lit("unknown provider: "), F.col("provider")))
    return have, bare.join(known, "provider", "left_semi"), rejected


class Artifacts:
    """The store a distiller reads: sanitised artifacts of the archive, filtered, and without those it has seen.

    Filters and the anti-join come before the redaction, which costs most.
    """

    def __init__(self, sessions: DataFrame, processed: DataFrame | None = None, sanitize: Callable[[DataFrame], DataFrame] | None = None, **filters):
        self.sessions, self.processed, self.sanitize, self.filters = sessions, processed, sanitize or (lambda df: df), filters

    def query(self, **filters) -> DataFrame:
        """Artifacts by repository, time and ids, whatever has been processed; the filters of the run don't count."""
        return artifacts(self.sanitize(scan(self.sessions, **filters)))

    def get_unprocessed(self, distiller: str, limit: int | None = None) -> DataFrame:
        """Artifacts that the distiller has not seen, in the order of the archive if there is a limit."""
        out = scan(self.sessions, **self.filters)
        if self.processed is not None:
            out = unprocessed(out, self.processed, distiller, limit)
        elif limit is not None:
            out = out.orderBy("repo", "captured_at", "session_id").limit(limit)
        return artifacts(self.sanitize(out))


def sanitize_messages(sessions: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Sessions with the contents of their messages redacted, and ``redacted_total``, the hits of the session.

    Messages are redacted as rows and put together by session again; a session is one row, so what is grouped is bounded by it.
    """
    keys = ["repo", "captured_at", "session_id"]
    rows = sessions.select(*keys, F.posexplode("messages").alias("at", "m")).withColumn("text", F.col("m.content"))
    done = redacted(rows, "text", ignore)
    by = done.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.col("text").alias("text"), F.col("redaction.total").alias("n")))).alias("x"))
    out = sessions.join(by, keys, "left")
    fixed = F.transform("messages", lambda m, i: m.withField("content", F.get("x", i)["text"]))
    return out.withColumns({"messages": fixed, "redacted_total": F.coalesce(F.aggregate("x", F.lit(0).cast("long"), lambda s, r: s + r["n"]), F.lit(0).cast("long"))}).drop("x")

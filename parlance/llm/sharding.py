"""Contiguous balanced shards from global prefix sums of byte sizes.

The rows are put in a total order by range partitions. Each partition gives one pair of totals (bytes, rows); their
prefix sums over the partitions are the only thing the driver sees. A second pass runs through each partition with
its offset and cuts where the running sum passes equal targets, so shards are contiguous in the order, and their
sizes differ by no more than the rows at the cuts.

Defined cases: null text has size ``overhead``; null ids come first; ties in the id are ordered by checksum and
size, and rows equal in all three are interchangeable; an empty table gives an empty result; other columns are
ignored, and the internal names cannot clash because the columns are selected first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, map_arrow, text_of

SHARDS = 24
OVERHEAD = 8


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size (UTF-8 bytes and the overhead) and text_crc32 of each row; no text leaves the scan."""
    text = text_of(docs, text_col)
    return docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def prefix_shards(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows of doc_id, size, text_crc32.

    A row belongs to the shard in which its middle byte lies, which puts each cut at the row boundary nearest to its
    target. Slots count from 0 in each shard without gaps.
    """
    order = ["doc_id", "text_crc32", "size"]
    parts = max(2, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the checkpoint fixes rows and partitions, so that both passes and any retry see the same order
    laid = cut(cut(sizes).repartitionByRange(parts, *order).sortWithinPartitions(*order))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = rows = 0
        for b in batches:
            size, rows = size + int(np.sum(b.column(0).to_numpy())), rows + b.num_rows
        yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "size": pa.array([size], pa.int64()), "n": pa.array([rows], pa.int64())})

    found = sorted(map_arrow(laid.select("size"), totals, "pid int, size long, n long", 10_000).collect())
    pids = [r["pid"] for r in found]
    before = dict(zip(pids, accumulate((r["size"] for r in found), initial=0), strict=False))
    total, whole = sum(r["size"] for r in found), "doc_id long, size long, text_crc32 long"

    def shard_of(sizes: np.ndarray, start: int) -> np.ndarray:
        # twice the position of the middle byte, so that all stays in integers
        middle = 2 * (start + np.cumsum(sizes) - sizes) + sizes
        return np.minimum(shards - 1, (middle.astype(object) * shards // (2 * max(1, total))).astype(np.int64)) if total > 2**55 else np.minimum(shards - 1, middle * shards // (2 * max(1, total)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        start, n = before.get(pid, 0), np.zeros(shards, np.int64)
        for b in batches:
            s = b.column(0).to_numpy()
            n += np.bincount(shard_of(s, start), minlength=shards)
            start += int(s.sum())
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid] * len(has), pa.int32()), "shard": pa.array(has, pa.int32()), "n": pa.array(n[has], pa.int64())})

    # contiguous shards: P + 24 rows at most, for P partitions
    first: dict[tuple[int, int], int] = {}
    reached: dict[int, int] = {}
    for r in sorted(map_arrow(laid.select("size"), counts, "pid int, shard int, n long", 10_000).collect()):
        first[r["pid"], r["shard"]] = reached.get(r["shard"], 0)
        reached[r["shard"]] = reached.get(r["shard"], 0) + r["n"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        start, at = before.get(pid, 0), {k: n for (p, k), n in first.items() if p == pid}
        for b in batches:
            s = b.column(1).to_numpy()
            to = shard_of(s, start)
            slot = np.zeros(len(s), np.int64)
            for k in np.unique(to):
                own = np.flatnonzero(to == k)
                slot[own] = at[int(k)] + np.arange(len(own))
                at[int(k)] += len(own)
            start += int(s.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32()), pa.array(slot, pa.int64())], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return map_arrow(laid, placed, f"{whole}, shard int, slot long", 10_000)


def op10_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``bytes``."""
    out = prefix_shards(measured(documents(spark, sf_dir)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute(rows: list[tuple[int, str | None]], shards: int = SHARDS, overhead: int = OVERHEAD) -> list[tuple]:
    """The same by one sorted list, for tests."""
    known = sorted((i, zlib.crc32(b), len(b) + overhead) for i, t in rows for b in [(t or "").encode()])
    total, start, out, slots = sum(k[2] for k in known), 0, [], [0] * shards
    for i, crc, size in known:
        k = min(shards - 1, (2 * start + size) * shards // (2 * total))
        out.append((i, size, crc, k, slots[k]))
        slots[k], start = slots[k] + 1, start + size
    return out


QUERIES = {"op10_prefix_shards": op10_prefix_shards}

#: What DuckDB can say of the result: it has no CRC-32, so this serves the tests and is no registered oracle.
PLACES_SQL = f"""
WITH m AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS BIGINT) AS size FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM m),
s AS (SELECT *, CAST(least({SHARDS - 1}, ((2 * before + size) * {SHARDS}) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM s
"""

"""Helpers that several operators share: cutting lineage, Arrow batch sizes, order-preserving buckets."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tasks over which one key of a join is dealt; AQE parts what is still skewed.
SALTS = 16
#: Words of 64 bits of a bitmap that is broadcast, 10 MB at most as rows.
BITMAP = 1 << 18
#: Rows of one Arrow batch that carries whole texts; with texts of 100 kB a batch stays below 30 MB.
TEXT_ROWS = 256


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the cluster shares.

    ``spark.checkpoint.dir`` is read from the session; a temporary folder is set only where none is (local tests).
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not (shared or sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="parlance-checkpoint-"))
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = TEXT_ROWS) -> DataFrame:
    """``mapInArrow`` with small batches, as rows hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(fn, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def edges(ids: DataFrame, col: str, per_bucket: int = 64, most: int = 65_536) -> list[int]:
    """Ascending values of ``col`` that cut it into buckets of about ``per_bucket`` rows; the first is the least.

    At most ``most`` values whatever the input, so that the list may travel in a plan as a literal.
    """
    n, least = ids.agg(F.count(col), F.min(col)).first()
    if not n:
        return []
    k = int(min(most, max(1, n // per_bucket)))
    cuts = ids.select(F.percentile_approx(col, [i / k for i in range(k)], 10 * max(k, 1000))).first()[0] if k > 1 else []
    return sorted({least, *cuts})


def held(value: Column) -> Column:
    """The same value, in a form that the optimizer computes where it stands: it is neither repeated in each expression that
    refers to it nor carried below it by a filter."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def literal(values: list, kind: str = "bigint") -> Column:
    """A literal array: one string that the optimizer folds, instead of a node for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """Index of the last cut at or below ``value``, by a binary search over a literal array (values below all: 0)."""
    if len(cuts) < 2:
        return F.lit(0)
    steps, step = [], 1 << ((len(cuts) - 1).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    at_most = literal(cuts)

    def go(at: Column, step: Column) -> Column:
        return F.when((at + step < len(cuts)) & (F.get(at_most, at + step) <= value), at + step).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), go)


def marked(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows with ``__may``: whether their hash ``col`` may be among ``keys``, by a broadcast bitmap of at most BITMAP words of 64 bits.

    False is certain; what is true by chance is for the caller's join to settle. A full bitmap says true of all rows.
    """
    place = lambda h: F.pmod(h, F.lit(BITMAP))
    bit = lambda h: F.shiftright(h, 40).bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = keys.groupBy(place(F.col(col)).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(col)))).alias("__bits"))
    some = rows.withColumn("__word", place(F.col(col))).join(F.broadcast(bits), "__word", "left")
    at = F.call_function("shiftright", F.coalesce("__bits", F.lit(0).cast("long")), bit(F.col(col)))
    return some.withColumn("__may", at.bitwiseAND(F.lit(1).cast("long")) == 1).drop("__word", "__bits")


def in_bitmap(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose hash ``col`` may be among ``keys``."""
    return marked(rows, keys, col).filter("__may").drop("__may")


def salted(left: DataFrame, right: DataFrame, keys: list[str], *deal: Column, how: str = "inner") -> DataFrame:
    """Join of many rows with unique keys, the rows of each key dealt over SALTS tasks by the columns ``deal``."""
    spread = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.withColumn("__salt", F.pmod(F.xxhash64(*deal), F.lit(SALTS)).cast("int")).join(spread, [*keys, "__salt"], how).drop("__salt")

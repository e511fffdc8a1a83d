"""Canonical exact digests.

A text is folded to its canonical form (NFKC, full case folding, NFKC again, runs of white space as one blank, ends
trimmed) and fingerprinted by two 64-bit xxHash values of different seeds. Rows that share a fingerprint are a bucket, and
inside a bucket the canonical bytes are compared, so that a class is what has equal bytes and not what has equal hashes.
All on the JVM: the Unicode forms come from the ICU library that Spark ships, by ``reflect``.

Defined cases: null text is the empty text; empty and blank texts share one class; repeated rows are each kept; null ids sort
below all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.llm.common import SALTS, bucket_of, cut, documents, edges, in_bitmap, literal, text_of

#: White space that NFKC leaves as it is.
OTHER_BLANKS = "\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\u0085\\u1680\\u2028\\u2029"
#: Only what has to change is matched, not each single blank.
BLANKS = f" [ {OTHER_BLANKS}]+|[{OTHER_BLANKS}][ {OTHER_BLANKS}]*"
SECOND_SEED = 0x5DEECE66D
NO_ID = -(2**63)


def canonical(text: Column) -> Column:
    """The canonical form; a null as the empty text. NFKC follows the folding too, as folding can undo it."""
    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), BLANKS, " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(SECOND_SEED).cast("long"), canon)


def hexed(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def with_next(docs: DataFrame) -> DataFrame:
    """key, doc_id, text and ``next_text``: the text of the next row in descending id, after the last that of the first.

    One shuffle of the texts: rows go to id ranges of about 64 rows, each range's greatest row also to the range above, and
    a window looks one row ahead in each range. The ranges come from the id column alone.
    """
    base = docs.select(F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("key"), docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    cuts = edges(base.select("key"), "key")
    if not cuts:
        return base.withColumn("next_text", F.lit(""))
    last = len(cuts) - 1
    # one value for each range, so at most 65,536 whatever the input
    tops = {r[0]: r[1] for r in base.select("key").groupBy(bucket_of(F.col("key"), cuts).alias("b")).agg(F.max("key")).collect()}
    top = F.get(literal([tops.get(b, NO_ID) for b in range(last + 1)]), F.col("b"))
    own = F.struct(F.col("b").alias("b"), F.lit(False).alias("ghost"))
    above = F.struct(F.when(F.col("b") == last, 0).otherwise(F.col("b") + 1).alias("b"), F.lit(True).alias("ghost"))
    dealt = base.withColumn("b", bucket_of(F.col("key"), cuts)).withColumn("at", F.explode(F.when(F.col("key") == top, F.array(own, above)).otherwise(F.array(own))))
    dealt = dealt.select("key", "doc_id", "text", F.col("at.b").alias("b"), F.col("at.ghost").alias("ghost"))
    # ghosts stand below all rows of the range; of several rows with the greatest id the one that sorts first is the neighbour
    w = Window.partitionBy("b").orderBy(F.col("ghost"), F.col("key").desc(), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(w)).filter(~F.col("ghost")).drop("b", "ghost")


def edited(text: Column, n: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the following text (or all it has)."""
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def grouped(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """``prints`` (key, kt, h1, h2 ...; kt names the text) with ``class_id`` and ``class_size``: the least id, and the rows, of equal canonical bytes.

    Counts of buckets are combined before they are shuffled. Only rows of buckets with several members have their bytes
    compared: grouping by the bytes is also combined before the shuffle, so a bucket that holds a third of all rows sends one
    row from each task. Where a bucket has one class, as all but hash collisions do, its rows get the class by the
    fingerprint; a join on the bytes settles the rest.
    """
    held = cut(prints.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("key").alias("least")).filter("n > 1"))
    spread = held.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    raw = docs.select(F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("key"), canonical(docs["text"]).alias("canon"), F.xxhash64(text_of(docs)).alias("kt"))
    h1, h2 = wide_hash(F.col("canon"))
    raw = raw.withColumns({"h1": h1, "h2": h2})
    # most other texts stay where they are, and a text that passes the bitmap by chance makes a class of its own
    members = in_bitmap(raw, held.select("h1"), "h1")
    classes = cut(members.groupBy("h1", "h2", "canon").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    collided = classes.groupBy("h1", "h2").agg(F.count("*").alias("classes")).filter("classes > 1").count()
    if not collided:
        got = salted.join(spread.select("h1", "h2", "salt", "least", "n"), ["h1", "h2", "salt"], "left")
    else:
        by_key = members.join(classes, ["h1", "h2", "canon"]).select("key", "kt", "h1", "h2", "least", "n").distinct()
        got = salted.join(by_key, ["key", "kt", "h1", "h2"], "left")
    return got.drop("salt").withColumns({"class_id": F.coalesce("least", "key"), "class_size": F.coalesce("n", F.lit(1)).cast("long")}).drop("least", "n", "kt")


def op3_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and the class of each."""
    docs = documents(spark, sf_dir)
    pairs = with_next(docs).withColumn("n_chars", F.char_length("text"))
    pairs = pairs.withColumn("edit", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    pairs = pairs.withColumns({"canon": canonical(F.col("text")), "edit_canon": canonical(F.col("edit")), "next_canon": canonical(F.col("next_text"))})
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)  # noqa: E731  the bytes are compared, not only the hashes
    h1, h2 = wide_hash(F.col("canon"))
    prints = cut(pairs.select("key", F.xxhash64("text").alias("kt"), "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), h1.alias("h1"), h2.alias("h2"), hexed(*wide_hash(F.col("edit_canon"))).alias("edited_fingerprint"), same("canon", "edit_canon").alias("near_edited"), same("canon", "next_canon").alias("near_next")))
    out = grouped(prints, docs)
    null_id = F.col("class_id") == NO_ID
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("h1"), F.col("h2")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", F.when(null_id, F.lit(None).cast(T.LongType())).otherwise(F.col("class_id")).alias("class_id"), "class_size")


QUERIES = {"op3_canonical_digest": op3_canonical_digest}

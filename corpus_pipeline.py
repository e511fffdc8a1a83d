"""A corpus pipeline of five of the library's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

1. quality: documents that the additive model scores below its threshold go.
2. lines: lines of templates that recur across documents are cut out of the texts.
3. near_copies: of documents connected by links (five words, similarity 0.8) the one with the least id stays.
4. mixture: documents are repeated or left out by the rates that match the target weights. In the fit, a document that is likelier of
   a domain the targets ask for more of than of any other has a rate of 1 at least, and none a rate above MOST.
5. packing: the tokens of what is left in sequences of 2048.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import jaccard, mixing, packing, quality, templates
from parlance.llm.common import cut, documents

#: Of what passes the quality stage, hardly a document is of the domain ``low``.
TARGETS = {"clean": 0.96, "low": 0.01, "toxic": 0.03}
MOST = 4.0
ORACLE_SQL = None


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of enough quality."""
    return quality.good(docs, labels(spark, sf_dir))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates."""
    out = templates.deduped(docs)
    cols = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        n = F.char_length("row.text").cast(docs.schema["n_chars"].dataType)
        cols[docs.columns.index("n_chars")] = F.when(F.size("dropped") > 0, n).otherwise(F.col("row.n_chars")).alias("n_chars")
    return out.select(*cols)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without a word belong to no group."""
    return jaccard.first_of_each(docs, words=5, percent=80)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them."""
    out, _ = mixing.mixed(docs, mixing.domain_of_labels(labels(spark, sf_dir)), TARGETS, least=1.0, most=MOST)
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_copies", near_copies_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before kept, cut off by a checkpoint in the shared folder."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""A corpus pipeline: each stage's rows are written as Parquet and read by the next.

Every stage takes any table with the columns of documents. A null text goes with
the quality rules, like an empty one; rows without an id, repeated rows and nulls
in other columns are no special case; other columns pass through, whatever they are
called; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import chosen_path, fuzzy_lines, mixing, packing, queries, repetition
from lintel.llm.common import shared_dir

#: Tokens of the mixture, as a share of what the stage is given.
MIX_SHARE = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of near-duplicate lines stays; n_chars follows the text.

    A document that loses its last word with them is a copy as a whole and goes.
    """
    gone = next(c for c in (f"removed{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    out = fuzzy_lines.without_near_lines(docs, n_removed=gone, min_words=1)
    emptied = (F.col(gone) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False))).drop(gone)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return chosen_path.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture's budget takes, each at most once."""
    taken = mixing.mixed(docs, queries.mixture(), queries.mixture_levels(), mixing.token_count(F.col("text")), share=MIX_SHARE, epochs=1, seed=queries.MIX_SEED)
    taken = taken.select(F.col("doc_id").alias("__taken"))
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__taken")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", pack)]

#: Tokenisation and retrieval cannot be expressed in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's output lies in the shared folder, the others' go once they are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
        if k:
            _remove(spark, f"{base}/{k - 1}_{STAGES[k - 1][0]}")
    return docs

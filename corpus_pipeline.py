"""From raw documents to token ids: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with
the columns of ``documents``; the last returns token ids.  Stages are written
and read again in between, so each works on what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credo.llm import bpe, minhash, mixing, pii, quality
from credo.llm.common import stored, text_or_empty
from credo.llm.queries import BPE_RANKS, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the table ``labels``, doesn't reject."""
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.one_of_each(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.masked(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = dict(docs.dtypes)["n_chars"]
    changed = F.length("text").cast(kind)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian unsigned 32-bit integers) of each document."""
    # the executors' memory still holds what earlier stages have grown to
    ids = bpe.encode(text_or_empty("text"), BPE_RANKS, public_tokenizers.PATTERN, share=0.15)
    return docs.select("doc_id", "source", ids.alias("ids")).select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("personal_data", mask),
    ("mixing", mix),
    ("encoding", encode),
]

#: The classifier and the near-duplicate hashes can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the corpus made from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to token ids: quality, repeated lines, near duplicates, source mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``docs``.  ``run`` writes every stage to the shared checkpoint folder and reads it again, so a lost
executor costs at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, linededup, minhash, mixing, qualitycrf
from folioscope.llm.common import ROW, crc_mod, cut, table
from folioscope.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 0.5 or more."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    model = qualitycrf.train(docs, labels, "doc_id", "text", "quality")
    return docs.where(qualitycrf.score_column("text", model, spark) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that five documents share stay in one of them."""
    found = linededup.dedup_lines(docs, "doc_id", "text", 40, 5)
    new = {"text": F.col("lines.text"), "n_chars": F.length("lines.text").cast("long")}
    return found.select(*[new.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 on five-word shingles join."""
    return minhash.representatives(docs, "doc_id", "text", 5, 80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts that bring sources to weights by the root of their size, in a global shuffle."""
    return mixing.shuffled(mixing.replicate(docs, "doc_id", "source", "text", alpha=0.5)).select(f"{ROW}.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the bytes decoded from them; columns of ``docs`` that have these names get ``_in`` at their end."""
    return bpe.encode_documents(docs, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("byte_bpe", byte_bpe)]

#: A trained model and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

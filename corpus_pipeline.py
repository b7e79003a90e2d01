"""The training-text pipeline over documents: toxicity, quality rules, near duplicates, mixing, BPE.

Every stage works on all that the one before kept; all but the last return the columns of documents, whatever they are called.

Defined cases: a null or empty text is not toxic, fails the base of the quality rules and so goes there, as texts of fewer than
50 words do; rows with a null doc_id are judged like others, never learned from and never near duplicates of a row that has
one; of rows with one id and text one stays; a null source is a source of its own, the last; a document of a source without
words cannot reach mixing; of equal texts the smallest doc_id stays; empty tables give no rows; tables without labels learn
nothing, and only fixed words and base counts decide. The last stage returns doc_id, n_tokens and the digests of ids and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, mixing, quality_rules, toxicity
from wordloom.llm.common import saved, table
from wordloom.llm.jaccard_join import keep_one


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]
#: The learned stages and BPE have no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

"""From raw documents to packed training sequences: each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, packing, pii, quality, simhash
from spanloom.llm.common import Stash, scratch, table

#: Expected share of the clean documents' tokens that mixing keeps. Given, so that no rare cell sets the rate of all.
MIXED_SHARE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity of 0.8 or more)."""
    return simhash.near_dedup(spark, docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked weights of source, language and topic; rare cells stay whole."""
    return mixing.sampled(spark, docs, keep_share=MIXED_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL can express a trained classifier or tagger.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the other stages write on their way is deleted when they have ended."""
    docs = table(spark, sf_dir, "documents")
    stash = Stash(spark, "pipeline", lasting=True)
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stash.put(stage(spark, docs, sf_dir))
        stash.drop_older()
    return STAGES[-1][1](spark, docs, sf_dir)

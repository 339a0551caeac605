"""A pipeline from raw documents to training shards: every stage applies one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents
it keeps, with their columns. Each stage's result is written as Parquet and reread for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirevault.llm import decontam, langid, mixing, neardup, sharding
from wirevault.llm.common import stored, table
from wirevault.session import configure

SHARDS = 40


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; the rest goes."""
    profiles = langid.prototypes(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accepted(docs, profiles)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.without_near_duplicates(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them, in its shuffled order; one of a source is cut at its quota's end.

    Null texts have no words and are not drawn; repeated rows are drawn each; an empty table stays empty.
    """
    return mixing.shuffled(mixing.mixture(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard; bytes are balanced over slots."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language ID", known_language),
    ("near-duplicates", one_of_each),
    ("decontamination", clean_of_benchmarks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Profiles of letters and sketches of shingles have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads back as the next one's ``docs``. All but the last return the columns of
``documents``: rejected or superseded rows are gone, and a document that the
mix takes twice is there twice.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the
operators' own docstrings say; extra columns are kept through all stages but
the last. Packing numbers the pieces of each row, so a repeated document has
its pieces in several sequences.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import block_naming, deobfuscate, mixing, packing, simhash_vp
from tideline.llm.common import free_name, shared_path, table

#: the stages end in packed pieces of a seeded mix; SQL can't express them (see tests/llm/test_pipeline.py)
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is scored below 0.5; learns from all labels."""
    model = deobfuscate.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__toxic")
    return deobfuscate.scored(docs, model, name=score).filter(F.col(score) < 0.5).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id."""
    return block_naming.without_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id."""
    return simhash_vp.one_of_each(docs, words_in_shingle=4, max_bits=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (weights 3, 1, 2) takes them, by output shard, each shuffled."""
    return mixing.shuffled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, capacity=2048)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("simhash near-dedup", simhash_near_dedup),
          ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

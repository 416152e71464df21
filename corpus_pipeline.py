"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing and tokens, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bpe, exact_dedup, langid, mixing, queries, similar
from quillspan.llm.common import cut
from quillspan.sources.tables import table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; texts without letters and unclear ones go."""
    return langid.keep_known(docs)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more; SimHash with
    BK-trees over all texts, then bands for the pairs beyond its radius."""
    return similar.keep_one(docs, width=5, threshold=0.8)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the rows' order in the files is the mixture at its target weights."""
    return mixing.in_mixed_order(docs, mixing.root_weights(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, counted and hashed, and the hash of what they decode to."""
    return bpe.digests(docs, queries.vocabulary())


STAGES = [("language_id", identify), ("exact_dedup", drop_equal), ("near_dedup", drop_near), ("mixing", blend), ("byte_bpe", tokenize)]

#: SQL cannot express the stages' models and fingerprints; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``: each one's rows are written as Parquet and read as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", compression="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training-data pipeline: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import bpe, mixing, near_dup, quality, toxicity
from lodestream.session import drop_since, mark, settle, table, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines too common among a source's documents go, and documents that the rules reject."""
    return quality.stage(tune(spark), docs, sf_dir)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labelled rows of sf_dir."""
    return toxicity.stage(tune(spark), docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 80 % one stays, that with the smallest id."""
    return near_dup.stage(tune(spark), docs, sf_dir)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass in which words of a document are taken, with those words."""
    return mixing.stage(tune(spark), docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    tune(spark)
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learned and hashed decisions are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again, and what led to it is removed."""
    docs = table(tune(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        point = mark(spark) - min(k, 1)  # the table before goes, too, once the next is written
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage{k}")
            drop_since(spark, point, keep=1)
    return docs

"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing and tokenisation, each over all that the one before kept.

Defined cases: null and empty texts fail the quality rules and go; a null source is a source of its own in line dedup and
mixing; of rows that share doc_id and text one stays; rows without an id are kept like others; very long texts are taken
whole; an empty table gives an empty result; further columns, whatever their names, pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trove.llm.common import stage
from trove.llm.line_dedup import cleaned
from trove.llm.mixing import mixed_corpus
from trove.llm.order_minhash import first_of_each
from trove.llm.quality import good_documents
from trove.llm.sentence_pieces import encode_documents

#: SQL can't express Order MinHash or sampled segmentation; tests hold each stage against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that consist of lines found all over their source, go."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines over the boilerplate ratio of their source go."""
    return cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target's words."""
    return mixed_corpus(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, with the check that they decode to its text."""
    return encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and read again, the last is returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swathframe.llm import mixing, packing, parity, pii, quality
from swathframe.llm.common import Scratch, table
from swathframe.llm.queries import labelled_domains, tokenizer_path


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id."""
    return parity.one_of_each(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, n_chars follows."""
    return pii.redacted(docs)


def at_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their rates. No rate is under 1: the mixture raises small domains and loses no document."""
    return mixing.resampled(docs, labelled_domains(spark, sf_dir, docs), temper=0.8, floor=1.0)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence."""
    return packing.packed(docs, tokenizer_path(), window=4096)


STAGES = [
    ("quality classifier", good_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_personal_data),
    ("mixing sources to target weights", at_target_weights),
    ("packing", in_sequences),
]

#: The stages fit models and iterate, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus through five stages: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the cluster's shared folder and reads it as the next stage's documents. All but the last return
the columns of ``documents``, in order, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfield.llm import common, packing, pii, quality_classifier, simhash_dedup, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from ``labels`` of the documents given.

    A null text is scored as an empty one. A score depends on the text alone, so repeated rows stay or go together; even scores (no labels) stay. An empty table stays empty.
    """
    with common.scope("pipeline"):
        return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    with common.scope("pipeline"):
        return simhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that repeat go; a character that loses some of its bytes goes whole. Documents stay, even if empty."""
    with common.scope("pipeline"):
        return suffix_dedup.cut_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind in brackets. Every row stays; null and empty texts stay as they are, and equal texts are masked alike."""
    with common.scope("pipeline"):
        return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences. A null or empty text is one piece of its end token; repeated rows are packed as often as they occur; an empty table gives no pieces."""
    with common.scope("pipeline"):
        return packing.packed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The discriminant, the components and the packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = common.write_kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.drop_path(spark, before)
        before = path
    with common.scope("pipeline"):  # drops the last stage's tables
        return docs

"""From raw documents to packed training sequences: five stages, each written and read again by the next.

quality rules -> line deduplication -> near-duplicates -> benchmark decontamination -> packing. A document that
breaks the quality rules, is near an earlier one, or holds a benchmark window goes; later repeats of runs of
lines are cut out of the texts of the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.decontaminate import without_leaks
from shelfline.llm.lines import without_repeated_lines
from shelfline.llm.packing import pack
from shelfline.llm.quality import good_documents
from shelfline.llm.simhash import without_near_duplicates
from shelfline.llm.similar import similar_groups
from shelfline.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that occur in an earlier one; `n_chars` follows the text."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return without_repeated_lines(docs).withColumn("n_chars", length)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that steps lead through: from a text to one whose
    fingerprint of three-word shingles is at most two bits away, or that shares four fifths of their different runs of
    five words."""
    return without_near_duplicates(docs, joined=similar_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 2048 ids in proportion to the sources."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The perplexity model, the fingerprints and the vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the `documents` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs

"""The training-data pipeline: five stages from raw documents to packed token sequences.

All stages but the last return documents with the columns and types they came with, extra ones included. The rules for nulls,
empty and very long texts, ties, rows that repeat and empty tables are those of the operators; in short: a null text counts as
empty and stays null, an empty table stays empty (a table of no labels or items lets all documents pass), of equal rows the
first or all are kept as the stage says, and no text is cut before the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontam, lines, packing, quality, simhash
from kindred.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for clean: of quality, and not toxic. Equal texts of a site share their fate;
    without labels of both kinds all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line equals or is one edit away from. A document may end up empty; blank
    lines and null texts stay; of equal rows all keep the same lines."""
    return lines.dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8. That of the smallest id stays;
    texts without words, null ones included, are one group."""
    return simhash.drop_near_duplicates(docs, k=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in copies of benchmark passages. Texts without words stay."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens. An empty or null text is one token."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the near-duplicates nor the packing; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

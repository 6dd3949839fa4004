"""A training corpus from raw documents: quality, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlens.llm import exact_dedup, jaccard_join, packing, quality, windows
from feedlens.llm.common import written
from feedlens.llm.queries import tokenizer_path
from feedlens.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the nearest-neighbour classifier rejects go."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_last(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays."""
    return jaccard_join.keep_first(spark, docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; every document stays, with what is left of its text."""
    return windows.without_repeats(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences: a row for each piece."""
    return packing.pack(spark, docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("substring dedup", passage_stage), ("best-fit packing", packing_stage)]

#: The classifier and the hashed windows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(spark, docs, f"stage-{i + 1}")
    return docs

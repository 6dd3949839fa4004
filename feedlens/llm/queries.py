"""Registered queries of this subpackage: the operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedlens.llm import (divergence, exact_dedup, fill_middle, fingerprints, jaccard_join, katz, packing, pieces, quality,
                          toxicity, url_filter, voronoi, windows)
from feedlens.sources.tables import table


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(spark, table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passages(spark, table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark, table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.tag(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.search(spark, table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_url_filter": op3_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op1_quality": op1_quality,
    "op2_compact_windows": op2_compact_windows,
    "op4_pieces": op4_pieces,
    "op5_katz": op5_katz,
    "op6_toxicity": op6_toxicity,
    "op10_packing": op10_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_voronoi": op11_voronoi,
    "op12_divergence": op12_divergence,
    "op13_fill_middle": op13_fill_middle,
}

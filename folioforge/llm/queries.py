"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.tables import table

from .chunking import oversized_ids, search_chunks
from .mixing import mix_report, mix_sources
from .offensive import found_categories, score_documents, source_rates
from .packing import fill_rates, pack
from .scanned import repair_scans, scan_noise
from .similar import similar_pairs, similar_rows
from .tokens import token_sizes


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_ids(table(spark, sf_dir, "ingest_chunks_stage"), "id", "text")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_chunks(table(spark, sf_dir, "ingest_chunks_stage"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "ingest_embeddings_stage"), "id", "embedding_text")


def p2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_rows(table(spark, sf_dir, "ingest_embeddings_stage"), "id", "embedding_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(table(spark, sf_dir, "ingest_chunks_stage"), "id", "text", "judgment_id", "pdf_page")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_scans(table(spark, sf_dir, "ingest_chunks_stage"), "id", "text", "judgment_id", "pdf_page")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "pack_sizes"))


def p6_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_rates(p6_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_categories(_scored(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rates(_scored(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_similar": p2_similar,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p6_packed": p6_packed,
    "p6_fill_rates": p6_fill_rates,
    "p7_selection": p7_selection,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_source_rates": p8_source_rates,
}

_WHITE = r"\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SQL = {
    "p1_found": f"SELECT DISTINCT id FROM ingest_chunks_stage WHERE id IS NOT NULL AND len(regexp_extract_all(text, '[^{_WHITE}]+')) > 220",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

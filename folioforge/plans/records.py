"""Queries on packed fields and references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.operators.orphans import orphan_counts, orphan_rows
from folioforge.operators.packed import split_packed
from folioforge.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "judgments").withColumnRenamed("id", "judgment_id").where("judgment_id IS NOT NULL")
    return split_packed(df, "available_languages", ["judgment_id"], "pos", "lang_value").distinct()


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, served = table(spark, sf_dir, "ingest_chunks_stage"), table(spark, sf_dir, "chunks")
    return orphan_rows(
        [("ingest_chunks_stage", stage, "id", "judgment_id", "staged_at"), ("chunks", served, "chunk_id", "judgment_id", "created_at")],
        (table(spark, sf_dir, "judgments"), "id", "ingested_at"),
        (table(spark, sf_dir, "judgment_removals"), "judgment_id"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).withColumnRenamed("row_id", "chunk_id").distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_counts": p5_counts}

_SPANS = r'''"(?:[^"]|"")*"|'[^']*'|\([^()]*\)'''
_ORPHANS = r"""
WITH held AS (SELECT lower(regexp_replace(id, '^[\s ]+|[\s ]+$', '', 'g')) k, min(ingested_at) since FROM judgments GROUP BY 1),
gone AS (SELECT DISTINCT lower(regexp_replace(judgment_id, '^[\s ]+|[\s ]+$', '', 'g')) k FROM judgment_removals),
refs AS (
  SELECT 'ingest_chunks_stage' source_table, id chunk_id, judgment_id, staged_at t FROM ingest_chunks_stage
  UNION ALL SELECT 'chunks', chunk_id, judgment_id, created_at FROM chunks),
keyed AS (SELECT *, lower(regexp_replace(judgment_id, '^[\s ]+|[\s ]+$', '', 'g')) k FROM refs WHERE judgment_id IS NOT NULL),
kinds AS (
  SELECT source_table, chunk_id, strftime(t, '%Y-%m') period_month,
    CASE WHEN held.k IS NULL AND gone.k IS NULL THEN 'missing' WHEN held.k IS NULL THEN 'deleted' WHEN since > t THEN 'late' END orphan_kind
  FROM keyed LEFT JOIN held ON held.k = keyed.k LEFT JOIN gone ON gone.k = keyed.k)
"""

SQL = {
    "p4_found": rf"""
WITH t AS (SELECT DISTINCT id, trim(available_languages, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) s FROM judgments WHERE available_languages IS NOT NULL AND id IS NOT NULL),
u AS (SELECT id, CASE WHEN regexp_full_match(s, '(?s)\[[^\[\]]*\]|\{{[^{{}}]*\}}') THEN substr(s, 2, length(s) - 2) ELSE s END s FROM t WHERE lower(s) NOT IN ('-', '--', 'n/a', 'na', 'n.a.', 'nil', 'none', 'null', 'unknown', '?')),
m AS (SELECT id, s, regexp_replace(s, $q${_SPANS}$q$, 'Q', 'g') bare FROM u),
w AS (SELECT id, CASE WHEN regexp_matches(bare, '[,;|/\n\r\t，、；｜／·•&＆]|(?i)(^|\s)(and|et|und|y)(\s|$)')
    THEN regexp_extract_all(regexp_replace(s, '(?i)\s(and|et|und|y)\s', '&', 'g'), $q$(?:{_SPANS}|[^,;|/\n\r\t，、；｜／·•&＆"'()]|["'()])+?(?:[,;|/\n\r\t，、；｜／·•&＆]|$)$q$)
    ELSE regexp_extract_all(s, $q$(?:{_SPANS}|\s+\(|\S)+$q$) END parts FROM m),
e AS (SELECT id, list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '[,;|/\n\r\t，、；｜／·•&＆]$', ''))), lambda p: p <> '' AND lower(p) NOT IN ('-', '--', 'n/a', 'na', 'nil', 'none', 'null', 'unknown', '?')) vals FROM w),
x AS (SELECT id, unnest(range(1, len(vals) + 1)) pos, unnest(vals) v FROM e)
SELECT DISTINCT id judgment_id, pos::INTEGER pos, CASE
  WHEN regexp_full_match(v, '".*"') THEN trim(replace(substr(v, 2, length(v) - 2), '""', '"'))
  WHEN regexp_full_match(v, '''.*''') THEN trim(substr(v, 2, length(v) - 2)) ELSE v END lang_value FROM x""",
    "p5_found": _ORPHANS + "SELECT DISTINCT source_table, chunk_id, period_month, orphan_kind FROM kinds WHERE orphan_kind IS NOT NULL",
    "p5_counts": _ORPHANS + "SELECT source_table, period_month, orphan_kind, count(*) n FROM kinds WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3",
}

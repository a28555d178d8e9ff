"""Document structure: paragraphs, merged parts, kinds of blocks, cited cases, judges, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import documents as D
from folioforge.sources.tables import table

from .passages import _order, _stage
from .registry import Family

family = Family()
_WHITE = r"\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_S = "s AS (SELECT DISTINCT id, judgment_id, pdf_page, paragraph_index, paragraph_number, part_index, text FROM ingest_chunks_stage WHERE judgment_id IS NOT NULL)"


@family.query()
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    p = docs.select("doc_id", F.posexplode(D.paragraphs("text")).alias("paragraph_index", "p"))
    return p.select("doc_id", "paragraph_index", F.col("p.number").alias("number"), F.col("p.text").alias("text"))


@family.query(f"""
WITH RECURSIVE {_S}, p AS (SELECT judgment_id, pdf_page, paragraph_index, text, row_number() OVER (PARTITION BY judgment_id, pdf_page, paragraph_index ORDER BY coalesce(part_index, 0), text) n,
  count(*) OVER (PARTITION BY judgment_id, pdf_page, paragraph_index) parts FROM s WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[{_WHITE}]+'), lambda x: x <> '') w FROM p),
f AS (SELECT judgment_id, pdf_page, paragraph_index, parts, n, text, w FROM w WHERE n = 1
  UNION ALL SELECT f.judgment_id, f.pdf_page, f.paragraph_index, f.parts, w.n, CASE WHEN k IS NULL THEN f.text || ' ' || w.text ELSE array_to_string(f.w || list_slice(w.w, k + 1, len(w.w)), ' ') END,
    CASE WHEN k IS NULL THEN f.w || w.w ELSE f.w || list_slice(w.w, k + 1, len(w.w)) END
  FROM f JOIN w ON w.judgment_id = f.judgment_id AND w.pdf_page IS NOT DISTINCT FROM f.pdf_page AND w.paragraph_index IS NOT DISTINCT FROM f.paragraph_index AND w.n = f.n + 1,
  LATERAL (SELECT list_max(list_filter(range(2, least(len(f.w), len(w.w)) + 1), lambda i: list_slice(f.w, len(f.w) - i + 1, len(f.w)) = list_slice(w.w, 1, i))) k))
SELECT judgment_id, pdf_page, paragraph_index, parts::INT parts, text FROM f WHERE n = parts""")
def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return D.merged_parts(_stage(spark, d), ["judgment_id", "pdf_page", "paragraph_index"], "part_index", "text")


@family.query(f"""
WITH {_S}, l AS (SELECT id, text, regexp_replace(text, '[^\\p{{L}}]', '', 'g') letters FROM s WHERE text IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(text, '^\\s*(?:\\*+|†|‡|\\d{{1,2}}\\s*\\.\\s*(?:See|Ibid|Supra))') THEN 'footnote'
  WHEN length(text) <= 120 AND length(letters) > 0 AND length(regexp_replace(letters, '[^\\p{{Lu}}]', '', 'g')) / length(letters)::DOUBLE >= 0.78 THEN 'heading' ELSE 'paragraph' END kind FROM l""")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _stage(spark, d).where("text IS NOT NULL").select("id", D.block_kind(F.col("text")).alias("kind")).distinct()


@family.query(r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\[\d{4}\] \d+ M\.C\.R\. \d+'))) cited, coalesce(regexp_extract(text, 'In ([A-Z]\S+) v\. ', 1), '') first_case FROM documents WHERE text IS NOT NULL""")
def cited_reports(spark: SparkSession, d: str) -> DataFrame:
    c = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\d{4}\] \d+ M\.C\.R\. \d+"), F.lit(0)))).cast("long")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", c.alias("cited"), F.regexp_extract("text", r"In ([A-Z]\S+) v\. ", 1).alias("first_case"))


@family.query(r"""
WITH n AS (SELECT DISTINCT judge FROM chunks WHERE judge IS NOT NULL), p AS (SELECT judge, unnest(regexp_split_to_array(judge, ',|;|\band\b|&')) x FROM n),
c AS (SELECT judge, trim(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\b(?:hon''?ble|mr|mrs|ms|dr|justice|the|chief|j\.?|c\.?j\.?i?|jj)\b\.?', ' ', 'g'), '[.*,]', ' ', 'g'), '\s+', ' ', 'g')) y FROM p)
SELECT judge, count(DISTINCT y) n FROM c WHERE y <> '' GROUP BY 1""")
def judge_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "chunks").where("judge IS NOT NULL").select("judge").distinct()
    return n.select("judge", F.size(D.judge_list(F.col("judge"))).cast("long").alias("n")).where("n > 0")


@family.query()
def chunk_prints(spark: SparkSession, d: str) -> DataFrame:
    return D.print_of(_stage(spark, d), "judgment_id", _order(), "text")


@family.query(f"""
WITH RECURSIVE {_S}, r AS (SELECT judgment_id, coalesce(pdf_page, 0) page, coalesce(paragraph_index, 0) para, coalesce(part_index, 0) part, id, paragraph_number,
  row_number() OVER (PARTITION BY judgment_id ORDER BY coalesce(pdf_page, 0), coalesce(paragraph_index, 0), coalesce(part_index, 0), id) n FROM s),
f AS (SELECT judgment_id, 0::BIGINT n, 0 cur FROM (SELECT DISTINCT judgment_id FROM r)
  UNION ALL SELECT f.judgment_id, r.n, CASE WHEN try_cast(r.paragraph_number AS INT) = f.cur + 1 AND regexp_full_match(r.paragraph_number, '\\d+') THEN f.cur + 1 ELSE f.cur END FROM f JOIN r ON r.judgment_id = f.judgment_id AND r.n = f.n + 1)
SELECT r.* EXCLUDE (n), f.cur paragraph FROM r JOIN f ON r.judgment_id = f.judgment_id AND r.n = f.n""")
def paragraph_sequence(spark: SparkSession, d: str) -> DataFrame:
    s = _stage(spark, d).select("judgment_id", F.coalesce("pdf_page", F.lit(0)).alias("page"), F.coalesce("paragraph_index", F.lit(0)).alias("para"), F.coalesce("part_index", F.lit(0)).alias("part"), "id", "paragraph_number")
    return D.in_sequence(s, "judgment_id", ["page", "para", "part", "id"], "paragraph_number")


@family.query(f"""
WITH RECURSIVE {_S}, r AS (SELECT judgment_id, id, strlen(coalesce(text, ''))::BIGINT bytes, row_number() OVER (PARTITION BY judgment_id ORDER BY id NULLS LAST) n FROM s),
f AS (SELECT judgment_id, 0::BIGINT n, 0 no, 0::BIGINT held FROM (SELECT DISTINCT judgment_id FROM r)
  UNION ALL SELECT f.judgment_id, r.n, CASE WHEN held > 0 AND held + bytes > 16384 THEN no + 1 ELSE no END, CASE WHEN held > 0 AND held + bytes > 16384 THEN bytes ELSE held + bytes END FROM f JOIN r ON r.judgment_id = f.judgment_id AND r.n = f.n + 1)
SELECT r.judgment_id, r.id, r.bytes, f.no batch_no FROM r JOIN f ON r.judgment_id = f.judgment_id AND r.n = f.n""")
def index_batches(spark: SparkSession, d: str) -> DataFrame:
    """Passages of each judgment in batches of at most 16 kB."""
    s = _stage(spark, d).select("judgment_id", "id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return D.byte_batches(s, "judgment_id", ["id"], "bytes", 16_384)


@family.query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(replace(text, chr(173), ''), '\s+', ' ', 'g')) x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(x) > 210 THEN rtrim(substr(x, 1, 209)) || '…' ELSE x END reason FROM t""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.excerpt(T.unhyphen(F.col("text")), 210).alias("reason"))


@family.query(r"""
SELECT source, string_agg(doc_id::VARCHAR, ' ' ORDER BY created_at NULLS FIRST, doc_id) ids, count(*) n FROM documents GROUP BY 1""")
def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("created_at", "doc_id")))
    g = table(spark, d, "documents").groupBy("source").agg(rows.alias("r"))
    return g.select("source", F.array_join(F.transform("r", lambda x: x["doc_id"].cast("string")), " ").alias("ids"), F.size("r").cast("long").alias("n"))


@family.query(r"SELECT doc_id, list_distinct(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1)) <> [] cites FROM documents WHERE text IS NOT NULL")
def inline_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.size(D.inline_sources(F.col("text"))) > 0).alias("cites"))


QUERIES, SQL = family.queries, family.sql

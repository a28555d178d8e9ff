"""Metadata: warnings, audits, overlays, folds; page tables and their look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import browse as B
from folioforge.operators import curation as C
from folioforge.operators import layout as L
from folioforge.operators import quality as U
from folioforge.operators.sequence import first_rows
from folioforge.sources.tables import table

from .browse import _J, _judgments
from .passages import _QUALITY, _ROUTES, _SCORE, _S, _metrics, _routes, _stage
from .registry import Family

family = Family()

_META = f"""{_J}, b AS (SELECT judgment_id id, list(name ORDER BY seat, name) judges FROM (SELECT DISTINCT judgment_id, judge_id, seat FROM judgment_judges) JOIN judges g ON g.id = judge_id GROUP BY 1),
w AS (SELECT j.id, list_filter([CASE WHEN b.judges IS NULL THEN 'missing_coram' END, CASE WHEN bench_size IS NULL THEN 'missing_bench_size' WHEN b.judges IS NOT NULL AND bench_size <> len(b.judges) THEN 'bench_coram_count_mismatch' END,
  CASE WHEN coalesce(trim(case_number), '') = '' THEN 'missing_case_number' END], lambda x: x IS NOT NULL) warnings FROM j LEFT JOIN b USING (id)),
m AS (SELECT id, warnings, CASE WHEN list_has_any(warnings, ['missing_coram', 'missing_bench_size', 'bench_coram_count_mismatch', 'author_not_in_coram']) THEN 'needs_review' ELSE 'verified' END status FROM w)"""


def _audited(spark: SparkSession, d: str) -> DataFrame:
    seats = B.seated(table(spark, d, "judgment_judges"), table(spark, d, "judges")).withColumnRenamed("judgment_id", "id")
    w = C.metadata_warnings(F.col("judges"), F.slice("judges", 1, 1), F.col("bench_size"), F.col("case_number"))
    return _judgments(spark, d).join(seats, "id", "left").select("id", w.alias("warnings")).withColumn("status", C.metadata_status(F.col("warnings")))


@family.query(f"WITH {_META} SELECT id, array_to_string(warnings, ',') warnings, status FROM m")
def metadata_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).select("id", F.array_join("warnings", ",").alias("warnings"), "status")


@family.query(f"WITH {_META}, e AS (SELECT status, unnest(CASE WHEN warnings = [] THEN ['none'] ELSE warnings END) warning FROM m) SELECT status, warning, count(*) n FROM e GROUP BY 1, 2")
def metadata_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many records have each status and warning."""
    e = _audited(spark, d).select("status", F.explode(F.when(F.size("warnings") == 0, F.array(F.lit("none"))).otherwise(F.col("warnings"))).alias("warning"))
    return e.groupBy("status", "warning").agg(F.count("*").alias("n"))


@family.query("""
WITH f AS (SELECT id, arg_min(court, (ingested_at, court)) court, arg_min(batch_id, (ingested_at, batch_id)) batch_id FROM judgments WHERE ingested_at IS NOT NULL AND court IS NOT NULL AND batch_id IS NOT NULL GROUP BY 1),
o AS (SELECT id, arg_max(court, (ingested_at, court)) court FROM judgments WHERE ingested_at IS NOT NULL AND court IS NOT NULL AND decision_year >= 1990 GROUP BY 1)
SELECT f.id, CASE WHEN o.id IS NOT NULL THEN o.court ELSE f.court END court, f.batch_id FROM f LEFT JOIN o USING (id)""")
def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The first load of each judgment, overlaid by the last load of the newer ones."""
    j = table(spark, d, "judgments").where("ingested_at IS NOT NULL AND court IS NOT NULL")
    first = j.where("batch_id IS NOT NULL").groupBy("id").agg(F.min_by("court", F.struct("ingested_at", "court")).alias("court"), F.min_by("batch_id", F.struct("ingested_at", "batch_id")).alias("batch_id"))
    last = j.where("decision_year >= 1990").groupBy("id").agg(F.max_by("court", F.struct("ingested_at", "court")).alias("court"))
    return C.overlay(first, last, "id")


@family.query("SELECT user_id || ':' || event_type AS k, arg_max(value, event_id) \"value\", min(event_id) place FROM events GROUP BY 1")
def last_at_first_place(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k"), "event_id", "value")
    return C.last_at_first_place(e, "k", "event_id")


@family.query("""
WITH r AS (SELECT DISTINCT doc_id, label, reviewer, labelled_at FROM review_labels), k AS (SELECT doc_id, reviewer, arg_max(label, (labelled_at, coalesce(label, ''))) label, max(labelled_at) updated, min(labelled_at) created FROM r WHERE labelled_at IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, reviewer, label, strftime(created, '%Y-%m-%d %H:%M:%S') created FROM k""")
def review_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer's last label of a document, with the time of the first."""
    r = table(spark, d, "review_labels").select("doc_id", "reviewer", "label", "labelled_at").where("labelled_at IS NOT NULL").distinct()
    key = F.struct("labelled_at", F.coalesce("label", F.lit("")))
    first = r.groupBy("doc_id", "reviewer").agg(F.min_by("label", key).alias("label"), F.min("labelled_at").alias("created"))
    last = r.groupBy("doc_id", "reviewer").agg(F.max_by("label", key).alias("label"), F.max("labelled_at").alias("created"))
    return C.upsert_keeping(first, last, ["doc_id", "reviewer"], "created").select("doc_id", "reviewer", "label", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@family.query(f"WITH {_J} SELECT id, row_number() OVER (PARTITION BY court ORDER BY coalesce(trim(decision_date), '') = '', decision_date, id) place FROM j")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return C.timeline(_judgments(spark, d), "court", "decision_date", "id").select("id", F.col("place").cast("long").alias("place"))


@family.query("SELECT DISTINCT judge_id FROM judgment_judges INTERSECT SELECT id FROM judges WHERE id % 2 = 1")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgment_judges").select("judge_id").intersect(table(spark, d, "judges").where("id % 2 = 1").select(F.col("id").alias("judge_id")))


@family.query("SELECT judgment_id FROM chunks WHERE judgment_id IS NOT NULL EXCEPT SELECT id FROM judgments")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("judgment_id IS NOT NULL").select("judgment_id").subtract(table(spark, d, "judgments").select("id"))


@family.query(f"WITH {_J} SELECT id, lower(strip_accents(title)) key FROM j WHERE title IS NOT NULL")
def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).where("title IS NOT NULL").select("id", C.folded(F.col("title")).alias("key"))


@family.query("SELECT vec_id, '[' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.8g', x)), ',') || ']' literal FROM embeddings")
def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", C.vector_literal("embedding").alias("literal"))


@family.query(f"WITH {_S} SELECT id, concat_ws(' · ', judgment_id, 'page ' || pdf_page, 'paragraph ' || paragraph_number) prefix FROM s")
def context_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What is written before a passage for its embedding: what is known of its place."""
    part = lambda word, c: F.concat(F.lit(word + " "), F.col(c).cast("string"))
    return _stage(spark, d).select("id", F.concat_ws(" · ", "judgment_id", part("page", "pdf_page"), part("paragraph", "paragraph_number")).alias("prefix"))


@family.query(f"WITH {_QUALITY}, r AS (SELECT *, {_SCORE} quality FROM q), k AS (SELECT judgment_id, id, quality, row_number() OVER (PARTITION BY judgment_id ORDER BY quality, id) n FROM r) SELECT judgment_id, id, quality FROM k WHERE n = 1")
def worst_pages(spark: SparkSession, d: str) -> DataFrame:
    """The passage of least quality of each judgment."""
    return first_rows(U.rated(_metrics(spark, d)), ["judgment_id"], [F.col("quality"), F.col("id")], 1).select("judgment_id", "id", "quality")


@family.query(f"WITH {_ROUTES}, a AS (SELECT q.judgment_id, CASE WHEN n_chars < 40 THEN 'ocr' WHEN route = 'reocr_recommended' AND scanned THEN 'reocr' ELSE 'keep' END action FROM q JOIN dr USING (judgment_id)) SELECT judgment_id, action, count(*) n FROM a WHERE action IN ('ocr', 'reocr') GROUP BY 1, 2")
def action_pages(spark: SparkSession, d: str) -> DataFrame:
    """Passages to be read again, by judgment and action."""
    m = _metrics(spark, d)
    a = m.join(_routes(m).select("judgment_id", "route"), "judgment_id").select("judgment_id", L.page_action(F.col("route"), F.col("n_chars"), F.col("scanned")).alias("action"))
    return a.where(F.col("action").isin("ocr", "reocr")).groupBy("judgment_id", "action").agg(F.count("*").alias("n"))


@family.query(f"WITH {_J} SELECT era, batch, count(*) n FROM (SELECT DISTINCT id, era, batch_id batch FROM judgments) GROUP BY 1, 2")
def era_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments").select("id", "era", F.col("batch_id").alias("batch")).distinct().groupBy("era", "batch").agg(F.count("*").alias("n"))


@family.query("""
WITH m AS (SELECT DISTINCT id FROM judgments), c AS (SELECT DISTINCT judgment_id id FROM judgment_judges)
SELECT id, 'no bench' gap FROM m WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'no judgment' FROM c WHERE id NOT IN (SELECT id FROM m)""")
def lookup_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What a strict look-up between two tables would stop at, both ways."""
    m = table(spark, d, "judgments").select("id").distinct()
    c = table(spark, d, "judgment_judges").select(F.col("judgment_id").alias("id")).distinct()
    return m.join(c, "id", "left_anti").withColumn("gap", F.lit("no bench")).unionByName(c.join(m, "id", "left_anti").withColumn("gap", F.lit("no judgment")))


@family.query(f"""
WITH {_S}, p AS (SELECT DISTINCT judgment_id, pdf_page FROM s WHERE pdf_page IS NOT NULL), e AS (SELECT judgment_id, pdf_page, text_source, sum(length(text)) n FROM s WHERE text_source IS NOT NULL AND pdf_page IS NOT NULL GROUP BY 1, 2, 3)
SELECT p.judgment_id, p.pdf_page, a.n::BIGINT embedded, t.n::BIGINT tesseract, d.n::BIGINT paddle, CASE WHEN t.n >= 40 THEN 'tesseract' WHEN d.n IS NOT NULL THEN 'paddle' WHEN a.n IS NOT NULL THEN 'embedded' END best FROM p
LEFT JOIN e a ON a.judgment_id = p.judgment_id AND a.pdf_page = p.pdf_page AND a.text_source = 'embedded'
LEFT JOIN e t ON t.judgment_id = p.judgment_id AND t.pdf_page = p.pdf_page AND t.text_source = 'tesseract'
LEFT JOIN e d ON d.judgment_id = p.judgment_id AND d.pdf_page = p.pdf_page AND d.text_source = 'paddle'""")
def page_results(spark: SparkSession, d: str) -> DataFrame:
    """A page with the size of what each engine read of it: one aggregation for the three left joins."""
    s = _stage(spark, d).where("pdf_page IS NOT NULL")
    engines = ["embedded", "tesseract", "paddle"]
    n = s.groupBy("judgment_id", "pdf_page").agg(*[F.sum(F.when(F.col("text_source") == e, F.length("text"))).alias(e) for e in engines])
    best = F.when(F.col("tesseract") >= 40, "tesseract").when(F.col("paddle").isNotNull(), "paddle").when(F.col("embedded").isNotNull(), "embedded")
    return n.select("judgment_id", "pdf_page", *engines, best.alias("best"))


@family.query(f"WITH {_S}, b AS (SELECT judgment_id, pdf_page, list(id ORDER BY id) ids FROM s WHERE pdf_page IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2) SELECT DISTINCT unnest(ids) chunk_id, judgment_id, pdf_page block FROM b")
def block_index(spark: SparkSession, d: str) -> DataFrame:
    """Which block a chunk is in, from the blocks' lists of chunks."""
    b = _stage(spark, d).where("pdf_page IS NOT NULL AND id IS NOT NULL").groupBy("judgment_id", "pdf_page").agg(F.collect_set("id").alias("ids"))
    return b.select(F.explode("ids").alias("chunk_id"), "judgment_id", F.col("pdf_page").alias("block")).distinct()


@family.query(f"""
WITH {_S}, r AS (SELECT DISTINCT id, text, text_source FROM s), y AS (SELECT id, list_filter([CASE WHEN text_source IS NULL THEN 'missing' END, CASE WHEN text_source IS NOT NULL AND length(trim(coalesce(text, ''))) < 40 THEN 'short' END], lambda x: x IS NOT NULL) w FROM r),
n AS (SELECT count(*) n, count(*) FILTER (w <> []) queued FROM y)
SELECT reason, count(*) n, round(any_value(queued) / any_value(n.n)::DOUBLE, 6) queue_rate FROM (SELECT unnest(w) reason FROM y), n GROUP BY 1""")
def fallback_queue(spark: SparkSession, d: str) -> DataFrame:
    """Why passages are queued to be read again, and the share of all that is."""
    s = _stage(spark, d).select("id", "text", "text_source").distinct()
    why = L.fallback_reasons(F.col("text"), F.lit(99.0), F.lit(None), F.col("text_source").isNotNull()).alias("w")
    y = s.select("id", why)
    rate = y.agg(F.round(F.count_if(F.size("w") > 0) / F.count("*"), 6).alias("queue_rate"))
    return y.select(F.explode("w").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).crossJoin(F.broadcast(rate))  # one row


QUERIES, SQL = family.queries, family.sql

"""Routing of pages, boxes, review rates, caches and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import documents as D
from folioforge.operators import index as I
from folioforge.operators import layout as L
from folioforge.operators import quality as Q
from folioforge.operators import search as S
from folioforge.sources.tables import table

from .passages import _stage
from .search import _BM25, _CHUNKS, _chunk_index
from .registry import Family

family = Family()


@family.query("""
SELECT l_orderkey page, min(l_linenumber)::DOUBLE "top", min(l_suppkey)::DOUBLE "left", max(l_linenumber + l_quantity)::DOUBLE bottom, max(l_suppkey + l_discount)::DOUBLE "right" FROM lineitem GROUP BY 1""")
def page_bounds(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    box = li.select(F.col("l_orderkey").alias("page"), *[F.col(a).cast("double").alias(b) for a, b in (("l_linenumber", "top"), ("l_suppkey", "left"), ("l_quantity", "height"), ("l_discount", "width"))])
    return L.bounds(box, ["page"])


@family.query("""
SELECT user_id, max(value - event_id % 5) - min(value - event_id % 5) <= 30 stable FROM events WHERE event_type = 'view' GROUP BY 1""")
def column_stability(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'view'").select("user_id", (F.col("event_id") % 5).cast("double").alias("a"), F.col("value").alias("b"))
    return L.stable_columns(e, ["user_id"], ["a", "b"], 30)


@family.query("""
WITH w AS (SELECT source, lang, count(*) n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
SELECT source, string_agg(lang || ':' || n, ' ' ORDER BY lang) langs FROM w GROUP BY 1""")
def merged_histograms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    m = L.merged_counts(docs.select("source", F.create_map("lang", F.lit(1).cast("long")).alias("langs")), ["source"], "langs")
    return m.select("source", F.array_join(F.transform(F.map_entries("langs"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ").alias("langs"))


@family.query("""
WITH s AS (SELECT DISTINCT id, text, text_source FROM ingest_chunks_stage WHERE judgment_id IS NOT NULL)
SELECT id, array_to_string(list_filter([CASE WHEN text_source IS NULL THEN 'missing' END, CASE WHEN text_source IS NOT NULL AND length(trim(coalesce(text, ''))) < 40 THEN 'short' END,
  CASE WHEN text_source IN ('embedded') THEN 'no confidence' END, CASE WHEN text_source = 'paddle' THEN 'low confidence' END], lambda x: x IS NOT NULL), ',') reasons FROM s""")
def recognition_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons to read a page again, with a confidence that stands for its source."""
    s = _stage(spark, d).select("id", "text", "text_source").distinct()
    conf = F.when(F.col("text_source") == "tesseract", 0.92).when(F.col("text_source") == "paddle", 0.7)
    why = L.fallback_reasons(F.col("text"), conf, F.lit(None), F.col("text_source").isNotNull())
    return s.select("id", F.array_join(why, ",").alias("reasons"))


@family.query("""
WITH s AS (SELECT DISTINCT judgment_id, paragraph_number FROM ingest_chunks_stage WHERE regexp_full_match(paragraph_number, '\\d+[A-Z]*') AND judgment_id IS NOT NULL)
SELECT judgment_id, string_agg(paragraph_number, ' ' ORDER BY regexp_extract(paragraph_number, '^(\\d+)', 1)::INT, length(regexp_extract(paragraph_number, '([A-Z]*)$', 1)), regexp_extract(paragraph_number, '([A-Z]*)$', 1), paragraph_number) numbers FROM s GROUP BY 1""")
def numbers_in_order(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "ingest_chunks_stage").where("judgment_id IS NOT NULL").where(F.col("paragraph_number").rlike(r"^\d+[A-Z]*$")).select("judgment_id", "paragraph_number").distinct()
    rows = F.array_sort(F.collect_list(F.struct(L.identifier_key(F.col("paragraph_number")).alias("k"), F.col("paragraph_number").alias("x"))))
    return s.groupBy("judgment_id").agg(rows.alias("r")).select("judgment_id", F.array_join(F.transform("r", lambda z: z["x"]), " ").alias("numbers"))


@family.query("""
WITH l AS (SELECT DISTINCT * FROM review_labels), p AS (SELECT doc_id, count(*) FILTER (label IS NOT NULL) labelled, count(*) FILTER (label IN ('abuse', 'hate', 'sexual')) bad FROM l GROUP BY 1)
SELECT round(sum(bad) / sum(labelled)::DOUBLE, 4) per_label, round(count(*) FILTER (bad > 0) / count(*) FILTER (labelled > 0)::DOUBLE, 4) per_document, count(*) FILTER (labelled = 0) unlabelled FROM p""")
def review_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of bad verdicts per label and per document, with what has no label apart."""
    p = table(spark, d, "review_labels").distinct().groupBy("doc_id").agg(F.count("label").alias("labelled"), F.count_if(F.col("label").isin("abuse", "hate", "sexual")).alias("bad"))
    return p.agg(
        Q.ratio(F.sum("bad"), F.sum("labelled")).alias("per_label"),
        Q.ratio(F.count_if(F.col("bad") > 0), F.count_if(F.col("labelled") > 0)).alias("per_document"),
        F.count_if(F.col("labelled") == 0).alias("unlabelled"),
    )


@family.query("""
WITH s AS (SELECT id, md5(string_agg(coalesce(text, ''), '~' ORDER BY text NULLS FIRST)) fp FROM (SELECT DISTINCT id, text FROM ingest_chunks_stage WHERE id IS NOT NULL) GROUP BY 1),
c AS (SELECT chunk_id id, md5(string_agg(coalesce(chunk_text, ''), '~' ORDER BY chunk_text NULLS FIRST)) fp FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks) GROUP BY 1)
SELECT id, fp FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = s.id AND c.fp = s.fp)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose fingerprint no served passage has."""

    def prints(df: DataFrame, key: str, text: str) -> DataFrame:
        g = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).distinct()
        texts = F.array_sort(F.collect_list(F.coalesce("t", F.lit(""))))
        return g.groupBy("id").agg(F.md5(F.array_join(texts, "~")).alias("fp"))

    return D.cached_misses(prints(table(spark, d, "ingest_chunks_stage"), "id", "text"), prints(table(spark, d, "chunks"), "chunk_id", "chunk_text"), ["id", "fp"])


@family.query("""
SELECT DISTINCT judgment_id, judge_id, seat FROM judgment_judges b WHERE EXISTS (SELECT 1 FROM judgments j WHERE j.id = b.judgment_id) AND EXISTS (SELECT 1 FROM judges g WHERE g.id = b.judge_id)
AND NOT EXISTS (SELECT 1 FROM judgment_removals r WHERE r.judgment_id = b.judgment_id)""")
def cascade_removed(spark: SparkSession, d: str) -> DataFrame:
    """The bridge after removed judgments are deleted with all that refers to them."""
    b = table(spark, d, "judgment_judges").distinct()
    b = b.join(table(spark, d, "judgments").select(F.col("id").alias("judgment_id")), "judgment_id", "left_semi")
    b = b.join(table(spark, d, "judges").select(F.col("id").alias("judge_id")), "judge_id", "left_semi")
    return b.join(table(spark, d, "judgment_removals").select("judgment_id"), "judgment_id", "left_anti").select("judgment_id", "judge_id", "seat")


@family.query("""
WITH c AS (SELECT DISTINCT chunk_id, judgment_id FROM chunks)
SELECT chunk_id, judgment_id, starts_with(chunk_id, judgment_id || ':') belongs, regexp_replace(chunk_id, ':part\\d+$', '') paragraph_key FROM c""")
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "judgment_id").distinct()
    return c.select("chunk_id", "judgment_id", F.startswith("chunk_id", F.concat("judgment_id", F.lit(":"))).alias("belongs"), F.regexp_replace("chunk_id", r":part\d+$", "").alias("paragraph_key"))


@family.query("""
WITH s AS (SELECT user_id, event_type q, max(ts) t, min(ts) f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, q) n FROM s)
SELECT user_id, q, n::BIGINT n FROM r WHERE n <= 3""")
def history(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest different queries, newest first, at most three."""
    from folioforge.operators.sequence import first_rows

    s = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("q")).agg(F.max("ts").alias("t"))
    return first_rows(s, ["user_id"], [F.desc("t"), F.asc("q")], 3, "n").select("user_id", "q", F.col("n").cast("long").alias("n"))


_ASK = "Municipal Board v. Collector"
_ASKED = ["municipal", "board", "collector"]


@family.query(
    _BM25.format(docs=_CHUNKS, terms=["municipal", "board", "v", "collector"])
    + rf""", c AS (SELECT DISTINCT chunk_id, judgment_id, title, citation FROM chunks),
t AS (SELECT *, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {tuple(T.TITLE_STOPS)}) w,
  list_filter(regexp_extract_all(lower(concat_ws(' ', title, citation)), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {tuple(T.TITLE_STOPS)}) b FROM c),
u AS (SELECT * EXCLUDE (w, b), array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') w, list_distinct(b) b FROM t),
ti AS (SELECT chunk_id, judgment_id, round(1 + len(list_intersect(b, {_ASKED})) / 3.0 + CASE WHEN w = '{" ".join(_ASKED)}' THEN 0.5 WHEN contains(w, '{" ".join(_ASKED)}') OR contains('{" ".join(_ASKED)}', w) THEN 0.2 ELSE 0 END, 6) score FROM u),
d1 AS (SELECT *, row_number() OVER (PARTITION BY judgment_id ORDER BY chunk_id) n FROM ti WHERE score >= 1.6),
d2 AS (SELECT chunk_id, judgment_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) r FROM d1 WHERE n = 1 ORDER BY r LIMIT 5),
h1 AS (SELECT bm.id chunk_id, c.judgment_id, bm.score, row_number() OVER (PARTITION BY c.judgment_id ORDER BY bm.score DESC, bm.id) n FROM bm JOIN c ON c.chunk_id = bm.id),
h2 AS (SELECT chunk_id, judgment_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) r FROM h1 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM d2 WHERE d2.judgment_id = h1.judgment_id) ORDER BY r LIMIT 10),
a AS (SELECT *, true direct FROM d2 UNION ALL SELECT *, false FROM h2)
SELECT chunk_id, judgment_id, score, direct FROM a ORDER BY direct DESC, r LIMIT 10"""
)
def search_titles_first(spark: SparkSession, d: str) -> DataFrame:
    """Search of passages in which judgments named by the query come first, and their passages only once."""
    c = table(spark, d, "chunks").select("chunk_id", "judgment_id", "title", "citation").dropDuplicates(["chunk_id"])
    hits = I.bm25(_chunk_index(spark, d), T.query_words(_ASK))
    named = c.withColumn("s", F.round(1 + T.title_score(_ASK, F.col("title"), F.col("citation")), 6)).where("s >= 1.6")
    first = S.collapse(named, "judgment_id", [F.asc("chunk_id")])
    direct = S.ranked(first.select("chunk_id", "judgment_id", F.col("s").alias("score")), [F.desc("score"), F.asc("chunk_id")], 5, "r").withColumn("direct", F.lit(True))
    rest = S.collapse(hits.select("chunk_id", "judgment_id", "score"), "judgment_id", [F.desc("score"), F.asc("chunk_id")])
    rest = rest.join(F.broadcast(direct.select(F.col("judgment_id").alias("j"))), F.col("judgment_id").eqNullSafe(F.col("j")), "left_anti")  # five at most
    rest = S.ranked(rest, [F.desc("score"), F.asc("chunk_id")], 10, "r").withColumn("direct", F.lit(False))
    return direct.unionByName(rest).orderBy(F.desc("direct"), "r").limit(10).drop("r")


QUERIES, SQL = family.queries, family.sql

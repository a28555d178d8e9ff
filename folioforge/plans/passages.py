"""Ordered passages: caps, budgets, runs, heads, fingerprints, contexts, citations, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import layout as L
from folioforge.operators import quality as U
from folioforge.operators import sequence as Q
from folioforge.session import spread
from folioforge.sources.tables import table

from .registry import Family

family = Family()
_S = "s AS (SELECT DISTINCT id, judgment_id, pdf_page, paragraph_index, paragraph_number, part_index, text, text_source FROM ingest_chunks_stage WHERE judgment_id IS NOT NULL)"
_ORDER = "coalesce(pdf_page, 0), coalesce(paragraph_index, 0), coalesce(part_index, 0), id"


def _stage(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "ingest_chunks_stage").where("judgment_id IS NOT NULL"))
    return s.select("id", "judgment_id", "pdf_page", "paragraph_index", "paragraph_number", "part_index", "text", "text_source").distinct()


def _order() -> list:
    return [F.coalesce(c, F.lit(0)) for c in ("pdf_page", "paragraph_index", "part_index")] + [F.col("id")]


@family.query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY judgment_id ORDER BY {_ORDER}) n FROM s) SELECT judgment_id, id, text FROM r WHERE n = 1")
def first_chunk(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_rows(_stage(spark, d), ["judgment_id"], _order(), 1).select("judgment_id", "id", "text")


@family.query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY judgment_id ORDER BY length(text) DESC, id) n FROM s WHERE text IS NOT NULL) SELECT judgment_id, id, n FROM r WHERE n <= 2")
def cap_per_judgment(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_rows(_stage(spark, d).where("text IS NOT NULL"), ["judgment_id"], [F.desc(F.length("text")), F.asc("id")], 2, "n").select("judgment_id", "id", F.col("n").cast("long"))


_SUM = f"sum(length(coalesce(text, ''))) OVER (PARTITION BY judgment_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)"


@family.query(f"WITH {_S}, r AS (SELECT *, {_SUM} t FROM s) SELECT judgment_id, id FROM r WHERE t <= 3000")
def context_prefix(spark: SparkSession, d: str) -> DataFrame:
    return Q.prefix_budget(_stage(spark, d), ["judgment_id"], _order(), F.length(F.coalesce("text", F.lit(""))), 3000).select("judgment_id", "id")


@family.query(f"WITH {_S}, r AS (SELECT *, {_SUM} t, row_number() OVER (PARTITION BY judgment_id ORDER BY {_ORDER}) n FROM s) SELECT judgment_id, id FROM r WHERE t <= 500 OR n = 1")
def context_prefix_first(spark: SparkSession, d: str) -> DataFrame:
    return Q.prefix_budget(_stage(spark, d), ["judgment_id"], _order(), F.length(F.coalesce("text", F.lit(""))), 500, keep_first=True).select("judgment_id", "id")


@family.query(f"""
WITH {_S}, r AS (SELECT *, lag(text_source) OVER w p, row_number() OVER w n FROM s WINDOW w AS (PARTITION BY judgment_id ORDER BY {_ORDER})),
g AS (SELECT *, sum(CASE WHEN n > 1 AND p IS NOT DISTINCT FROM text_source THEN 0 ELSE 1 END) OVER (PARTITION BY judgment_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) run FROM r)
SELECT judgment_id, run::BIGINT run, any_value(text_source) text_source, count(*) n, min(pdf_page) first_page, max(pdf_page) last_page FROM g GROUP BY judgment_id, run""")
def source_runs(spark: SparkSession, d: str) -> DataFrame:
    g = Q.islands(_stage(spark, d), ["judgment_id"], _order(), F.col("text_source"))
    return g.groupBy("judgment_id", "run").agg(F.any_value("text_source").alias("text_source"), F.count("*").alias("n"), F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page"))


@family.query(f"""
WITH {_S}, p AS (SELECT judgment_id, pdf_page, min(paragraph_index) a FROM s WHERE pdf_page IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, pdf_page - row_number() OVER (PARTITION BY judgment_id ORDER BY pdf_page) k FROM p)
SELECT judgment_id, min(pdf_page) first_page, max(pdf_page) last_page, count(*) pages FROM r GROUP BY judgment_id, k HAVING count(*) >= 2""")
def page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of at least two consecutive pages."""
    from pyspark.sql import Window

    p = _stage(spark, d).where("pdf_page IS NOT NULL").select("judgment_id", "pdf_page").distinct()
    k = p.withColumn("k", F.col("pdf_page") - F.row_number().over(Window.partitionBy("judgment_id").orderBy("pdf_page")))
    spans = k.groupBy("judgment_id", "k").agg(F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page"), F.count("*").alias("pages"))
    return spans.where("pages >= 2").drop("k")


@family.query(f"""
WITH {_S}, r AS (SELECT id, judgment_id, last_value(paragraph_number IGNORE NULLS) OVER (PARTITION BY judgment_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) carried FROM s) SELECT id, judgment_id, carried FROM r""")
def carried_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _stage(spark, d).select("id", "judgment_id", Q.carried(F.col("paragraph_number"), ["judgment_id"], _order()).alias("carried"))


@family.query(f"""
WITH {_S}, r AS (SELECT *, lag(pdf_page) OVER (PARTITION BY judgment_id ORDER BY paragraph_index, part_index, id) p FROM s WHERE pdf_page IS NOT NULL)
SELECT judgment_id, count(*) backward FROM r WHERE pdf_page < p GROUP BY 1""")
def pages_backward(spark: SparkSession, d: str) -> DataFrame:
    """How often the page goes back in order of paragraphs."""
    from pyspark.sql import Window

    w = Window.partitionBy("judgment_id").orderBy(F.asc_nulls_last("paragraph_index"), F.asc_nulls_last("part_index"), "id")
    r = _stage(spark, d).where("pdf_page IS NOT NULL").withColumn("p", F.lag("pdf_page").over(w))
    return r.where("pdf_page < p").groupBy("judgment_id").agg(F.count("*").alias("backward"))


@family.query(f"""
WITH {_S}, l AS (SELECT judgment_id, pdf_page, unnest(string_split(text, chr(10))) line FROM s WHERE contains(text, chr(10))),
p AS (SELECT judgment_id, pdf_page, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') print FROM l)
SELECT judgment_id, print, count(DISTINCT pdf_page) pages FROM p WHERE print <> '' GROUP BY 1, 2 HAVING count(DISTINCT pdf_page) >= 2""")
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    lines = _stage(spark, d).where(F.contains("text", F.lit("\n"))).select("judgment_id", "pdf_page", F.explode(F.split("text", "\n")).alias("line"))
    return Q.repeated_heads(lines, "judgment_id", "pdf_page", "line")


@family.query(f"""
WITH {_S}, k AS (SELECT judgment_id, min(CASE WHEN paragraph_number = '1' THEN (coalesce(pdf_page, 0), coalesce(paragraph_index, 0)) END) f FROM s GROUP BY 1)
SELECT s.id, s.judgment_id FROM s JOIN k USING (judgment_id) WHERE k.f IS NULL OR (coalesce(pdf_page, 0), coalesce(paragraph_index, 0)) >= k.f""")
def from_paragraph_one(spark: SparkSession, d: str) -> DataFrame:
    """Drop what stands before the first paragraph 1, where there is one."""
    s = _stage(spark, d)
    at = F.struct(F.coalesce("pdf_page", F.lit(0)).alias("a"), F.coalesce("paragraph_index", F.lit(0)).alias("b"))
    first = s.groupBy("judgment_id").agg(F.min(F.when(F.col("paragraph_number") == "1", at)).alias("f"))
    return s.withColumn("at", at).join(first, "judgment_id").where(F.col("f").isNull() | (F.col("at") >= F.col("f"))).select("id", "judgment_id")


@family.query(f"""
WITH {_S} SELECT judgment_id, sha256(string_agg(id || '|' || coalesce(text, ''), '~' ORDER BY {_ORDER})) fingerprint, count(*) chunks FROM s GROUP BY 1""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat_ws("|", "id", F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order())], item.alias("x"))))
    g = _stage(spark, d).groupBy("judgment_id").agg(rows.alias("r"))
    return g.select("judgment_id", F.sha2(F.array_join(F.transform("r", lambda x: x.x), "~"), 256).alias("fingerprint"), F.size("r").cast("long").alias("chunks"))


@family.query(f"""
WITH {_S}, w AS (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w FROM s WHERE text IS NOT NULL)
SELECT id, i::INT window_no, array_to_string(list_slice(w, i * 40 + 1, i * 40 + 50), ' ') piece FROM w, range(0, greatest(ceil((len(w) - 10) / 40.0)::INT, 1)) t(i) WHERE len(w) > 50""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 50 words that share 10, of the longer texts."""
    s = _stage(spark, d).where("text IS NOT NULL").withColumn("n", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))
    return s.where("n > 50").select("id", F.posexplode(T.word_windows(F.col("text"), 50, 10)).alias("window_no", "piece"))


@family.query(f"WITH {_S} SELECT id FROM s WHERE length(trim(text)) >= 20 AND len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= 2")
def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _stage(spark, d).where(T.searchable(F.col("text"))).select("id")


_SIGNS = r"""[\p{L}\p{N}\s.,;:!?''\-()\[\]/"%&§₹–—]"""
_QUALITY = f"""{_S}, c AS (SELECT word FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}'))) word FROM (SELECT DISTINCT id, text FROM s)) GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT DISTINCT judgment_id, id, text, coalesce(text_source, '') <> 'embedded' scanned FROM s WHERE text IS NOT NULL),
m AS (SELECT judgment_id, id, scanned, length(text) n_chars, len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) n_words, len(regexp_extract_all(text, '\\S+')) n_tokens,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: regexp_matches(t, '[A-Za-z][0-9!|;{{}}~][A-Za-z]|[A-Za-z][.!?,;:][A-Za-z]'))) n_suspicious,
  length(regexp_replace(text, '\\s', '', 'g')) n_signs, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) n_alpha, length(regexp_replace(text, '{_SIGNS}', '', 'g')) n_odd, text FROM p),
n AS (SELECT judgment_id, id, text, count(*) n_common FROM (SELECT judgment_id, id, text, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) word FROM p) JOIN c USING (word) GROUP BY 1, 2, 3),
q AS (SELECT m.* EXCLUDE (text), coalesce(n_common, 0) n_common FROM m LEFT JOIN n ON m.judgment_id = n.judgment_id AND m.id IS NOT DISTINCT FROM n.id AND m.text = n.text)"""
_SCORE = """round(greatest(0, least(1, 0.65 * coalesce(n_common / nullif(n_words, 0)::DOUBLE, 0) + 0.35 * least(coalesce(n_alpha / nullif(n_signs, 0)::DOUBLE, 0) / 0.95, 1)
  - least(coalesce(n_suspicious / nullif(n_tokens, 0)::DOUBLE, 0) * 2, 0.1) - least(coalesce(n_odd / nullif(n_signs, 0)::DOUBLE, 0) * 5, 0.1))), 6)::DOUBLE"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _stage(spark, d).select("judgment_id", "id", "text", (F.coalesce("text_source", F.lit("")) != "embedded").alias("scanned")).distinct()
    common = U.common_words(spread(table(spark, d, "ingest_chunks_stage").where("judgment_id IS NOT NULL").select("id", "text")).distinct(), "text")
    return U.text_metrics(rows, ["judgment_id", "id", "scanned"], "text", common)


@family.query(f"""
WITH {_QUALITY}, r AS (SELECT *, {_SCORE} quality FROM q)
SELECT * EXCLUDE (judgment_id, scanned), CASE WHEN quality < 0.75 THEN 'severe' WHEN quality < 0.9 THEN 'moderate' ELSE 'mild' END severity FROM r""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """Counts, a quality in 0..1 and its bucket; common words are those of at least five passages."""
    return U.rated(_metrics(spark, d)).drop("judgment_id", "scanned")


_ROUTES = f"""{_QUALITY}, dq AS (SELECT judgment_id, count(*) pages, count(*) FILTER (n_chars < 40) missing, count(*) FILTER (scanned) scans, sum(n_common) n_common, sum(n_words) n_words, sum(n_alpha) n_alpha, sum(n_signs) n_signs,
  sum(n_suspicious) n_suspicious, sum(n_tokens) n_tokens, sum(n_odd) n_odd FROM q GROUP BY 1),
ds AS (SELECT *, {_SCORE} quality FROM dq),
dr AS (SELECT judgment_id, pages, missing, scans, quality, CASE WHEN missing = pages THEN 'ocr_required' WHEN scans > 0 AND quality < 0.95 THEN 'reocr_recommended' WHEN missing > 0 THEN 'selective_ocr_required'
  WHEN scans > 0 THEN 'existing_ocr_usable' ELSE 'digital_text' END route FROM ds)"""


def _routes(m: DataFrame) -> DataFrame:
    sums = m.groupBy("judgment_id").agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") < L.MIN_TEXT).alias("missing"), F.count_if("scanned").alias("scans"), *[F.sum(c).alias(c) for c in U.RATED])
    route = L.document_route(F.col("pages"), F.col("missing"), F.col("scans"), F.col("quality"))
    return U.rated(sums).select("judgment_id", "pages", "missing", "scans", "quality", route.alias("route"))


@family.query(f"WITH {_ROUTES} SELECT * FROM dr")
def document_routes(spark: SparkSession, d: str) -> DataFrame:
    """What each judgment needs: the quality is that of all its text, from the sums of its passages' counts."""
    return _routes(_metrics(spark, d))


@family.query(f"WITH {_ROUTES} SELECT q.id, CASE WHEN n_chars < 40 THEN 'ocr' WHEN route = 'reocr_recommended' AND scanned THEN 'reocr' ELSE 'keep' END action FROM q JOIN dr USING (judgment_id)")
def page_actions(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return m.join(_routes(m).select("judgment_id", "route"), "judgment_id").select("id", L.page_action(F.col("route"), F.col("n_chars"), F.col("scanned")).alias("action"))


@family.query(r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:Section|Article|Rule) \d+[A-Z]?')) ref FROM documents) SELECT ref, count(*) mentions, count(DISTINCT doc_id) docs FROM r GROUP BY 1""")
def statute_refs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:Section|Article|Rule) \d+[A-Z]?"), F.lit(0))).alias("ref"))
    return r.groupBy("ref").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


_EDGES = "e AS (SELECT l_orderkey citing, l_partkey cited, l_linenumber page, CASE l_returnflag WHEN 'N' THEN NULL ELSE l_returnflag END treatment, l_linestatus = 'F' reviewed FROM lineitem)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_linenumber").alias("page"), F.nullif("l_returnflag", F.lit("N")).alias("treatment"), (F.col("l_linestatus") == "F").alias("reviewed")
    )


@family.query(f"WITH {_EDGES} SELECT e.citing, e.page, e.treatment, strftime(o.o_orderdate, '%Y-%m-%d') decided FROM e JOIN orders o ON o.o_orderkey = e.citing WHERE e.cited = 42 ORDER BY o.o_orderdate DESC, e.page, e.citing LIMIT 100")
def citator(spark: SparkSession, d: str) -> DataFrame:
    """Who cites a record, latest first: edges filtered before the join, the treatment where there is one."""
    e = _edges(spark, d).where("cited = 42")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("citing"), "o_orderdate")
    return e.join(o, "citing").orderBy(F.desc("o_orderdate"), "page", "citing").limit(100).select("citing", "page", "treatment", F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided"))


@family.query(f"WITH {_EDGES} SELECT treatment, count(*) mentions, count(DISTINCT citing) citing FROM e WHERE reviewed AND treatment IS NOT NULL GROUP BY 1")
def citator_reviewed(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where("reviewed AND treatment IS NOT NULL").groupBy("treatment").agg(F.count("*").alias("mentions"), F.count_distinct("citing").alias("citing"))


@family.query("SELECT user_id thread_id, count(*) messages, strftime(max(ts), '%Y-%m-%d %H:%M:%S') updated FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 50")
def thread_list(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("thread_id")).agg(F.count("*").alias("messages"), F.max("ts").alias("u"))
    return t.orderBy(F.desc("u"), "thread_id").limit(50).select("thread_id", "messages", F.date_format("u", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@family.query("SELECT user_id thread_id, arg_max(event_id, (ts, event_id)) last_click FROM events WHERE event_type = 'click' GROUP BY 1")
def thread_last_turn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("thread_id")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_click"))


@family.query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, round(value)::BIGINT c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, 0::BIGINT n, 0::BIGINT s, '' items FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT f.user_id, e.n, CASE WHEN e.c > 0 AND f.s + e.c <= 90 THEN f.s + e.c ELSE f.s END, CASE WHEN e.c > 0 AND f.s + e.c <= 90 THEN concat_ws(',', e.event_id::VARCHAR, nullif(f.items, '')) ELSE f.items END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1 WHERE e.n <= 8)
SELECT user_id, items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) r FROM f) WHERE r = 1""")
def thread_context(spark: SparkSession, d: str) -> DataFrame:
    """Of the newest eight turns of each thread those that fit a budget, newest first."""
    e = table(spark, d, "events").withColumn("cost", F.round(F.col("value")).cast("long"))
    return Q.skipping_budget(e, "user_id", "event_id", "cost", ["ts", "event_id"], 90, 8).select("user_id", F.array_join("items", ",").alias("items"))


QUERIES, SQL = family.queries, family.sql

"""Loading, merging, sampling, checking and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import merge as M
from folioforge.operators import quality as Q
from folioforge.operators import sampling as A
from folioforge.sources.tables import table

from .registry import Family

family = Family()
_STAGED = """st AS (SELECT DISTINCT id chunk_id, judgment_id, text, text_source FROM ingest_chunks_stage WHERE id IS NOT NULL),
se AS (SELECT DISTINCT chunk_id, judgment_id, chunk_text text, text_source FROM chunks)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_chunks_stage").where("id IS NOT NULL").select(F.col("id").alias("chunk_id"), "judgment_id", "text", "text_source").distinct()


def _served(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "judgment_id", F.col("chunk_text").alias("text"), "text_source").distinct()


@family.query(f"WITH {_STAGED} SELECT * FROM st UNION ALL SELECT * FROM se WHERE chunk_id NOT IN (SELECT chunk_id FROM st)")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return M.upsert(_served(spark, d), _staged(spark, d), ["chunk_id"])


@family.query(f"WITH {_STAGED} SELECT * FROM se UNION ALL SELECT * FROM st WHERE chunk_id NOT IN (SELECT chunk_id FROM se)")
def merge_insert_missing(spark: SparkSession, d: str) -> DataFrame:
    return M.insert_missing(_served(spark, d), _staged(spark, d), ["chunk_id"])


_J = "j AS (SELECT DISTINCT id, cnr, bench_size, disposal_nature FROM judgments)"


@family.query(f"""
WITH {_J}, c AS (SELECT judgment_id id, count(DISTINCT judge_id) n FROM judgment_judges GROUP BY 1)
SELECT j.id, j.cnr, coalesce(c.n, j.bench_size)::BIGINT bench_size, j.disposal_nature FROM j LEFT JOIN c USING (id)""")
def merge_update_from(spark: SparkSession, d: str) -> DataFrame:
    """Bench sizes replaced by what the bridge counts, kept where it has nothing."""
    j = table(spark, d, "judgments").select("id", "cnr", F.col("bench_size").cast("long").alias("bench_size"), "disposal_nature").distinct()
    c = table(spark, d, "judgment_judges").groupBy(F.col("judgment_id").alias("id")).agg(F.count_distinct("judge_id").alias("bench_size"))
    return M.update_from(j, c, ["id"], ["bench_size"])


@family.query("""
WITH b AS (SELECT DISTINCT judgment_id, judge_id, seat FROM judgment_judges), c AS (SELECT judgment_id, count(*) k FROM b GROUP BY 1),
w AS (SELECT c.judgment_id FROM c JOIN (SELECT DISTINCT id, bench_size FROM judgments) j ON j.id = c.judgment_id WHERE j.bench_size IS DISTINCT FROM c.k),
n AS (SELECT judgment_id, judge_id, row_number() OVER (PARTITION BY judgment_id ORDER BY judge_id) - 1 seat FROM b WHERE judgment_id IN (SELECT judgment_id FROM w))
SELECT judgment_id, judge_id, seat::INT seat FROM n UNION ALL SELECT * FROM b WHERE judgment_id NOT IN (SELECT judgment_id FROM n)""")
def merge_replace_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Benches of another size than recorded are seated anew as a whole, in order of judges."""
    from pyspark.sql import Window

    b = table(spark, d, "judgment_judges").distinct()
    j = table(spark, d, "judgments").select(F.col("id").alias("judgment_id"), "bench_size").distinct()
    wrong = b.groupBy("judgment_id").agg(F.count("*").alias("k")).join(j, "judgment_id").where(~F.col("bench_size").eqNullSafe(F.col("k")))
    seat = F.row_number().over(Window.partitionBy("judgment_id").orderBy("judge_id")) - 1
    fresh = b.join(wrong, "judgment_id", "left_semi").select("judgment_id", "judge_id", seat.alias("seat"))
    return M.replace_groups(b, fresh, "judgment_id")


@family.query("SELECT user_id, arg_max(event_type, (ts, event_id)) event_type, arg_max(event_id, (ts, event_id)) event_id, count(*) attempts FROM events GROUP BY 1")
def ledger_last_state(spark: SparkSession, d: str) -> DataFrame:
    return M.last_state(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@family.query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) status FROM events GROUP BY 1)
SELECT status, count(*) n FROM l GROUP BY 1""")
def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.last_state(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"]).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@family.query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) status FROM events GROUP BY 1)
SELECT DISTINCT e.user_id FROM events e JOIN l USING (user_id) WHERE l.status <> 'purchase'""")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    done = M.last_state(e, "user_id", ["ts", "event_id"], ["event_type"]).where("event_type = 'purchase'")
    return e.select("user_id").distinct().join(done, "user_id", "left_anti")


@family.query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 128)::BIGINT group_no FROM documents")
def shard_numbers(spark: SparkSession, d: str) -> DataFrame:
    return M.numbered_groups(table(spark, d, "documents").select("doc_id"), [F.asc("doc_id")], 128)


@family.query("""
WITH m AS (SELECT DISTINCT id, title, 'judgment' kind FROM judgments WHERE era = '1970-1989'), n AS (SELECT DISTINCT judgment_id id, title, 'judgment' kind FROM chunks WHERE citation LIKE '[19%')
SELECT * FROM m UNION SELECT * FROM n""")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "judgments").where("era = '1970-1989'").select("id", "title", F.lit("judgment").alias("kind"))
    b = table(spark, d, "chunks").where("citation LIKE '[19%'").select(F.col("judgment_id").alias("id"), "title", F.lit("judgment").alias("kind"))
    return a.union(b).distinct()


@family.query("SELECT id, count(*) n FROM judgments GROUP BY 1 HAVING count(*) > 1")
def duplicate_judgments(spark: SparkSession, d: str) -> DataFrame:
    return Q.duplicate_keys(table(spark, d, "judgments"), ["id"])


@family.query("""
WITH s AS (SELECT DISTINCT id FROM ingest_chunks_stage), e AS (SELECT DISTINCT id FROM ingest_embeddings_stage)
SELECT id, 'no vector' gap FROM s WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT id, 'no chunk' FROM e WHERE id NOT IN (SELECT id FROM s)""")
def chunk_vector_gaps(spark: SparkSession, d: str) -> DataFrame:
    s, e = (table(spark, d, t).select("id").distinct() for t in ("ingest_chunks_stage", "ingest_embeddings_stage"))
    return s.join(e, "id", "left_anti").withColumn("gap", F.lit("no vector")).unionByName(e.join(s, "id", "left_anti").withColumn("gap", F.lit("no chunk")))


@family.query("""
WITH r AS (SELECT DISTINCT id, pdf_page, paragraph_index, part_index, text, text_source FROM ingest_chunks_stage)
SELECT id AS "key", unnest(list_filter([CASE WHEN pdf_page < 1 THEN 'page below 1' END, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' END,
  CASE WHEN text_source IS NULL THEN 'no source' END, CASE WHEN NOT regexp_full_match(id, '.+:p\\d{4}:para\\d{4}:part\\d{2}') THEN 'bad id' END], lambda x: x IS NOT NULL)) rule FROM r""")
def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ingest_chunks_stage").select("id", "pdf_page", "paragraph_index", "part_index", "text", "text_source").distinct()
    return Q.violations(
        rows,
        "id",
        {
            "page below 1": F.col("pdf_page") < 1,
            "no text": F.col("text").isNull() | (F.trim("text") == ""),
            "no source": F.col("text_source").isNull(),
            "bad id": ~F.col("id").rlike(r"^.+:p\d{4}:para\d{4}:part\d{2}$"),
        },
    )


@family.query("""
WITH j AS (SELECT DISTINCT id, bench_size, pdf_url, decision_date, cnr FROM judgments)
SELECT id AS "key", unnest(list_filter([CASE WHEN bench_size NOT BETWEEN 1 AND 50 THEN 'bench size' END, CASE WHEN NOT starts_with(pdf_url, 'https://') THEN 'url' END,
  CASE WHEN NOT regexp_full_match(decision_date, '\\d{4}-\\d{2}-\\d{2}') THEN 'date' END, CASE WHEN cnr IS NULL THEN 'no cnr' END], lambda x: x IS NOT NULL)) rule FROM j""")
def judgment_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judgments").select("id", "bench_size", "pdf_url", "decision_date", "cnr").distinct()
    rules = {
        "bench size": ~F.col("bench_size").between(1, 50),
        "url": ~F.col("pdf_url").startswith("https://"),
        "date": ~F.col("decision_date").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "no cnr": F.col("cnr").isNull(),
    }
    return Q.violations(rows, "id", rules)


@family.query("SELECT DISTINCT judge, chunk_id FROM chunks c WHERE judge IS NOT NULL AND NOT EXISTS (SELECT 1 FROM judges g WHERE g.name = c.judge)")
def unknown_judges(spark: SparkSession, d: str) -> DataFrame:
    """Served passages that name a judge without a record."""
    c = table(spark, d, "chunks").select("judge", "chunk_id").distinct()
    return Q.missing_parents(c, "judge", table(spark, d, "judges"), "name")


@family.query("""
WITH a AS (SELECT batch_id, count(DISTINCT id) left_n FROM ingest_chunks_stage WHERE batch_id IS NOT NULL GROUP BY 1), b AS (SELECT batch_id, count(DISTINCT id) right_n FROM judgments WHERE batch_id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.batch_id, b.batch_id) batch_id, coalesce(left_n, 0) left_n, coalesce(right_n, 0) right_n FROM a FULL JOIN b ON a.batch_id = b.batch_id WHERE coalesce(left_n, 0) <> coalesce(right_n, 0)""")
def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    s, j = (table(spark, d, t).where("batch_id IS NOT NULL").select("batch_id", "id").distinct() for t in ("ingest_chunks_stage", "judgments"))
    return Q.compare_counts(s, j, "batch_id")


_C = "c AS (SELECT DISTINCT id, era, decision_year, bench_size FROM judgments WHERE era IS NOT NULL)"


@family.query(f"""
WITH {_C}, v AS (SELECT id, era, CASE WHEN bench_size IS NULL THEN 'severe' WHEN bench_size > 2 THEN 'moderate' ELSE 'mild' END severity FROM c),
h AS (SELECT *, sha256('gold:' || id) h, CASE severity WHEN 'severe' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END l FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY era, severity ORDER BY h, id) r FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY r, l, id) s FROM r)
SELECT id, era, severity FROM s ORDER BY s, era LIMIT 40""")
def sample_balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judgments").where("era IS NOT NULL").select("id", "era", "decision_year", "bench_size").distinct()
    level = F.when(F.col("bench_size").isNull(), "severe").when(F.col("bench_size") > 2, "moderate").otherwise("mild")
    return A.balanced_sample(rows.select("id", "era", level.alias("severity")), "era", "severity", "id", ["severe", "moderate", "mild"], 40, "gold")


@family.query("""
WITH f AS (SELECT doc_id, 'flagged' bucket FROM documents WHERE n_chars < 200 ORDER BY sha256('g:' || doc_id), doc_id LIMIT 30), c AS (SELECT doc_id, 'clean' bucket FROM documents WHERE n_chars >= 200 ORDER BY sha256('g:' || doc_id), doc_id LIMIT 20),
a AS (SELECT * FROM f UNION ALL SELECT * FROM c) SELECT doc_id, bucket, 'GOLD-' || lpad(row_number() OVER (ORDER BY sha256('g:' || doc_id), doc_id)::VARCHAR, 3, '0') gold_id FROM a""")
def gold_set(spark: SparkSession, d: str) -> DataFrame:
    """30 flagged and 20 clean documents in one order of review."""
    from pyspark.sql import Window

    h = A.stable_order("g", F.col("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    flagged = docs.where("n_chars < 200").orderBy(h, "doc_id").limit(30).select("doc_id", F.lit("flagged").alias("bucket"))
    clean = docs.where("n_chars >= 200").orderBy(h, "doc_id").limit(20).select("doc_id", F.lit("clean").alias("bucket"))
    n = F.row_number().over(Window.orderBy(h, "doc_id"))
    return flagged.unionByName(clean).withColumn("gold_id", F.concat(F.lit("GOLD-"), F.lpad(n.cast("string"), 3, "0")))


@family.query("SELECT id, (row_number() OVER (ORDER BY id) - 1) % 3 worker FROM (SELECT DISTINCT id FROM judgments)")
def worker_tasks(spark: SparkSession, d: str) -> DataFrame:
    return A.round_robin(table(spark, d, "judgments").select("id").distinct(), ["id"], 3).select("id", F.col("worker").cast("long"))


_RUNS = """g AS (SELECT user_id case_id, list_distinct(list(event_id % 40 ORDER BY event_id)) relevant FROM events WHERE event_type = 'purchase' GROUP BY 1),
r AS (SELECT user_id case_id, list(event_id % 40 ORDER BY ts, event_id) found FROM events WHERE event_type = 'click' GROUP BY 1)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("x", F.col("event_id") % 40)
    listed = lambda kind, order, name: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "x"))), lambda s: s["x"]).alias(name))
    return listed("purchase", ["event_id"], "relevant").withColumn("relevant", F.array_distinct("relevant")).join(listed("click", ["ts", "event_id"], "found"), "case_id", "left")


@family.query(f"""
WITH {_RUNS}, d AS (SELECT g.case_id, relevant, list_filter(found, lambda x, i: list_position(found, x) = i) f FROM g LEFT JOIN r USING (case_id))
SELECT case_id, CASE WHEN f IS NULL THEN 'missing_run' ELSE 'scored' END status, round(len(list_intersect(list_slice(f, 1, 20), relevant)) / len(relevant)::DOUBLE, 4) recall_20 FROM d""")
def eval_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall among the first 20 different ids; a case without a run is missing, not zero."""
    both = _runs(spark, d)
    return both.select("case_id", F.when(F.col("found").isNull(), "missing_run").otherwise("scored").alias("status"), Q.recall_at(F.col("found"), F.col("relevant"), 20).alias("recall_20"))


@family.query("""
WITH l AS (SELECT DISTINCT * FROM review_labels), p AS (SELECT reviewer, count(*) FILTER (label = 'none') n_none, count(*) FILTER (label IN ('abuse', 'hate', 'sexual')) n_bad, count(*) FILTER (label IS NOT NULL AND label <> 'unsure') n FROM l GROUP BY 1)
SELECT reviewer, n labelled, CASE WHEN n > 0 THEN round(n_bad / n::DOUBLE, 4) END bad_share, CASE WHEN n_bad > 0 THEN round(n_none / n_bad::DOUBLE, 4) END none_per_bad FROM p""")
def eval_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Shares with their denominators; null where nothing was labelled."""
    p = table(spark, d, "review_labels").distinct().groupBy("reviewer").agg(
        F.count_if(F.col("label") == "none").alias("n_none"),
        F.count_if(F.col("label").isin("abuse", "hate", "sexual")).alias("n_bad"),
        F.count_if(F.col("label").isNotNull() & (F.col("label") != "unsure")).alias("labelled"),
    )
    return p.select("reviewer", "labelled", Q.ratio(F.col("n_bad"), F.col("labelled")).alias("bad_share"), Q.ratio(F.col("n_none"), F.col("n_bad")).alias("none_per_bad"))


@family.query("""
WITH l AS (SELECT DISTINCT doc_id, label FROM review_labels WHERE label IS NOT NULL), p AS (SELECT doc_id, count(*) kinds FROM l GROUP BY 1)
SELECT kinds, count(*) documents FROM p GROUP BY 1""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "review_labels").where("label IS NOT NULL").select("doc_id", "label").distinct().groupBy("doc_id").agg(F.count("*").alias("kinds"))
    return p.groupBy("kinds").agg(F.count("*").alias("documents"))


@family.query("""
SELECT event_type, count(*) n, count(*) FILTER (v >= 0.98) n98, count(*) FILTER (v >= 0.9) n90, count(*) FILTER (v < 0.8) low, round(avg(v), 6) mean FROM (SELECT event_type, least(value / 40, 1) v FROM events) GROUP BY 1""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and counts above thresholds of a share per group."""
    v = table(spark, d, "events").select("event_type", F.least(F.col("value") / 40, F.lit(1.0)).alias("v"))
    at = lambda c, n: F.count_if(c).alias(n)
    return v.groupBy("event_type").agg(F.count("*").alias("n"), at(F.col("v") >= 0.98, "n98"), at(F.col("v") >= 0.9, "n90"), at(F.col("v") < 0.8, "low"), F.round(F.avg("v"), 6).alias("mean"))


@family.query("""
SELECT user_id, json_extract_string(props, '$.k')::INT k, count(*) n, max(value) - min(value) spread FROM events GROUP BY 1, 2""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return e.groupBy("user_id", "k").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"))


@family.query("""
WITH b AS (SELECT l_orderkey page, l_linenumber top, l_linenumber + l_quantity / 25.0 bottom, l_partkey block FROM lineitem), r AS (SELECT l_orderkey page, l_linenumber + 0.25 top, l_suppkey line FROM lineitem)
SELECT r.page, r.line, count(DISTINCT b.block) blocks FROM r JOIN b ON b.page = r.page AND b.top <= r.top + 0.75 AND b.bottom >= r.top - 0.75 GROUP BY 1, 2""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines within blocks of their page, 0.75 either way: a hash join on the page with the bounds as its condition."""
    li = table(spark, d, "lineitem")
    b = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("btop"), (F.col("l_linenumber") + F.col("l_quantity") / 25.0).alias("bottom"), F.col("l_partkey").alias("block"))
    r = li.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") + 0.25).alias("top"), F.col("l_suppkey").alias("line"))
    met = r.join(b, "page").where((F.col("btop") <= F.col("top") + 0.75) & (F.col("bottom") >= F.col("top") - 0.75))
    return met.groupBy("page", "line").agg(F.count_distinct("block").alias("blocks"))


QUERIES, SQL = family.queries, family.sql

"""Browsing judgments: filters, sorts, pages, totals, facets, benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import browse as B
from folioforge.sources.tables import table

from .registry import Family

family = Family()
_J = "j AS (SELECT DISTINCT * EXCLUDE (ingested_at, batch_id) FROM judgments)"
_ISO = "CASE WHEN regexp_full_match(decision_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(decision_date AS DATE) IS NOT NULL THEN decision_date END"
_ROW = "id, title, decision_date, decision_year"


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments").drop("ingested_at", "batch_id").distinct()


def _row(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "decision_date", "decision_year")


def _filtered(spark: SparkSession, d: str, **f) -> DataFrame:
    return _row(B.browse_filter(_judgments(spark, d), B.Filters(**f), table(spark, d, "judgment_judges"), table(spark, d, "judges")))


for _name, _where, _args in [
    ("browse_year_range", "decision_year BETWEEN 1970 AND 1999", {"year_from": 1970, "year_to": 1999}),
    ("browse_year_from", "decision_year >= 2010", {"year_from": 2010}),
    ("browse_date_range", f"{_ISO} BETWEEN '1980-01-01' AND '1995-12-31'", {"date_from": "1980-01-01", "date_to": "1995-12-31"}),
    ("browse_date_bad_bound", f"{_ISO} <= '1995-12-31'", {"date_from": "1980-02-31", "date_to": "1995-12-31"}),
    ("browse_era_court", "era IN ('1970-1989', '2010-2019') AND court IN ('Supreme Court of Meridia')", {"era": ["1970-1989", "2010-2019 "], "court": ["Supreme Court of Meridia"]}),
    ("browse_disposal", "disposal_nature IN ('Appeal dismissed', 'Withdrawn by leave')", {"disposal": ["Appeal dismissed", "Withdrawn by leave", ""]}),
    ("browse_party_contains", "contains(lower(petitioner), 'union') OR contains(lower(respondent), 'union')", {"party": "UNION"}),
    ("browse_reporter_contains", "contains(lower(citation), '8 m.c.r.')", {"reporter": "8 M.C.R."}),
    ("browse_neutral_prefix", "starts_with(lower(neutral_citation), '19')", {"neutral_citation": "19"}),
    ("browse_bench_range", "bench_size BETWEEN 2 AND 3", {"bench_min": 2, "bench_max": 3}),
    ("browse_bench_in", "bench_size IN (1, 5)", {"bench": [1, 5]}),
    ("browse_csv_language", "list_has_any(string_split(upper(replace(available_languages, ' ', '')), ','), ['ENG', 'TAM'])", {"language": ["eng", "TAM"]}),
    (
        "browse_judge_semijoin",
        "EXISTS (SELECT 1 FROM judgment_judges b JOIN judges g ON g.id = b.judge_id WHERE b.judgment_id = j.id AND g.name IN (SELECT name FROM judges WHERE id IN (3, 7, 11)))",
        None,
    ),
]:

    def _make(args):
        def run(spark: SparkSession, d: str) -> DataFrame:
            if args is None:
                names = [r.name for r in table(spark, d, "judges").where("id IN (3, 7, 11)").collect()]  # three
                return _filtered(spark, d, judges=names)
            return _filtered(spark, d, **args)

        return run

    _f = _make(_args)
    _f.__name__ = _name
    family.query(f"WITH {_J} SELECT {_ROW} FROM j WHERE {_where}")(_f)


def _sorted(name: str, sort: str, order: str, number: int, size: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return B.page(_row(_judgments(spark, d)), sort, number, size)

    run.__name__ = name
    family.query(f"WITH {_J} SELECT {_ROW} FROM j ORDER BY {order} LIMIT {size} OFFSET {(number - 1) * size}")(run)


_sorted("browse_recent", "recent", f"{_ISO} DESC NULLS LAST, id", 1, 20)
_sorted("browse_oldest", "oldest", f"{_ISO} ASC NULLS LAST, id", 2, 20)
_sorted("browse_title", "title", "title ASC NULLS LAST, id", 3, 20)


@family.query(f"WITH {_J} SELECT {_ROW} FROM j LIMIT 0")
def browse_too_deep(spark: SparkSession, d: str) -> DataFrame:
    return B.page(_row(_judgments(spark, d)), "recent", 2501, 20)


@family.query(f"WITH {_J} SELECT count(*) total, count(decision_date) dated, count(DISTINCT court) courts FROM j")
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).agg(F.count("*").alias("total"), F.count("decision_date").alias("dated"), F.count_distinct("court").alias("courts"))


_LIMITS = {"disposal_nature": 40, "era": 10, "decision_year": 200, "bench_size": 20}


@family.query(
    f"WITH {_J}, v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' facet, {c}::VARCHAR AS \"value\", count(*) n FROM j WHERE {c} IS NOT NULL GROUP BY 2" for c in _LIMITS)
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, \"value\") r FROM v) SELECT facet, \"value\", n FROM r WHERE r <= CASE facet "
    + " ".join(f"WHEN '{c}' THEN {k}" for c, k in _LIMITS.items())
    + " END"
)
def facet_scalars(spark: SparkSession, d: str) -> DataFrame:
    return B.facets(_judgments(spark, d), _LIMITS)


@family.query(f"""
WITH {_J} SELECT g.name AS "value", count(DISTINCT j.id) n FROM j JOIN judgment_judges b ON b.judgment_id = j.id JOIN judges g ON g.id = b.judge_id
WHERE decision_year >= 1990 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100""")
def facet_judges(spark: SparkSession, d: str) -> DataFrame:
    kept = B.browse_filter(_judgments(spark, d), B.Filters(year_from=1990)).select(F.col("id").alias("judgment_id"))
    seats = table(spark, d, "judgment_judges").select("judgment_id", "judge_id").distinct().join(kept, "judgment_id", "left_semi")
    n = seats.groupBy("judge_id").agg(F.count("*").alias("n"))
    named = n.join(table(spark, d, "judges").withColumnRenamed("id", "judge_id"), "judge_id").groupBy(F.col("name").alias("value")).agg(F.sum("n").alias("n"))
    return named.orderBy(F.desc("n"), "value").limit(100)


@family.query(f"""
WITH {_J}, b AS (SELECT era AS "value", count(*) n FROM j WHERE era IS NOT NULL GROUP BY 1), s AS (SELECT unnest(['1970-1989', '1830-1850']) v)
SELECT coalesce("value", v) AS "value", coalesce(n, 0) n FROM b FULL JOIN s ON v = "value" """)
def facet_selected_merge(spark: SparkSession, d: str) -> DataFrame:
    return B.with_selected(B.facets(_judgments(spark, d), {"era": 10}), ["1970-1989", "1830-1850"])


_SEATED = """
b AS (SELECT DISTINCT judgment_id, judge_id, seat FROM judgment_judges),
s AS (SELECT b.judgment_id, string_agg(g.name, '; ' ORDER BY seat, g.name) judges, count(*) bench FROM b JOIN judges g ON g.id = b.judge_id GROUP BY 1)"""


@family.query(f"WITH {_J}, {_SEATED} SELECT j.id, j.title, s.judges, s.bench FROM j LEFT JOIN s ON s.judgment_id = j.id")
def browse_benches(spark: SparkSession, d: str) -> DataFrame:
    s = B.seated(table(spark, d, "judgment_judges"), table(spark, d, "judges")).withColumnRenamed("judgment_id", "id")
    both = _judgments(spark, d).select("id", "title").join(s, "id", "left")
    return both.select("id", "title", F.array_join("judges", "; ").alias("judges"), F.when(F.col("judges").isNotNull(), F.size("judges")).cast("long").alias("bench"))


@family.query(f"WITH {_J}, {_SEATED} SELECT j.id, j.bench_size, s.bench counted FROM j JOIN s ON s.judgment_id = j.id WHERE j.bench_size IS DISTINCT FROM s.bench")
def bench_mismatch(spark: SparkSession, d: str) -> DataFrame:
    s = B.seated(table(spark, d, "judgment_judges"), table(spark, d, "judges")).select(F.col("judgment_id").alias("id"), F.size("judges").cast("long").alias("counted"))
    return _judgments(spark, d).select("id", "bench_size").join(s, "id").where(~F.col("bench_size").eqNullSafe(F.col("counted")))


@family.query(f"""
WITH {_J} SELECT id, coalesce(neutral_citation, citation, 'uncited') shown, CASE WHEN pdf_key IS NULL THEN 'missing' ELSE 'ready' END processing_status,
  CASE WHEN length(title) > 30 THEN rtrim(substr(title, 1, 29)) || '…' ELSE title END short_title, nullif(bench_size, 0) bench FROM j""")
def browse_rows(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).select(
        "id",
        F.coalesce("neutral_citation", "citation", F.lit("uncited")).alias("shown"),
        F.when(F.col("pdf_key").isNull(), "missing").otherwise("ready").alias("processing_status"),
        T.excerpt(F.col("title"), 30).alias("short_title"),
        F.nullif("bench_size", F.lit(0)).alias("bench"),
    )


@family.query(f"""
WITH {_J}, p AS (SELECT id, regexp_extract(title, '(?i)^(.*?)\\s+(?:v\\.?|vs\\.?|versus)\\s+(.*)$', ['a', 'b']) m FROM j)
SELECT id, trim(m['a']) first_party, trim(m['b']) second_party FROM p WHERE m['a'] <> ''""")
def split_titles(spark: SparkSession, d: str) -> DataFrame:
    rx = r"(?i)^(.*?)\s+(?:v\.?|vs\.?|versus)\s+(.*)$"
    j = _judgments(spark, d).select("id", *[F.trim(F.regexp_extract("title", rx, i)).alias(n) for i, n in ((1, "first_party"), (2, "second_party"))])
    return j.where("first_party <> ''")


@family.query(f"""
WITH {_J} SELECT id, CASE WHEN regexp_full_match(decision_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN decision_date END iso, try_cast(regexp_extract(citation, '(\\d+)$', 1) AS INT) first_page FROM j""")
def typed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that are no ISO dates become null; the reporter's page is the citation's last number."""
    return _judgments(spark, d).select(
        "id", F.when(F.col("decision_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("decision_date")).alias("iso"), F.expr(r"try_cast(regexp_extract(citation, '(\\d+)$', 1) AS INT)").alias("first_page")
    )


@family.query(f"""
WITH c AS (SELECT DISTINCT chunk_id, judgment_id FROM chunks), k AS (SELECT judgment_id, count(*) n FROM c GROUP BY 1), {_J}
SELECT j.id, coalesce(k.n, 0) passages FROM j LEFT JOIN k ON k.judgment_id = j.id ORDER BY passages DESC, j.id LIMIT 50""")
def passage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Left join and count per parent, the first fifty."""
    k = table(spark, d, "chunks").select("chunk_id", F.col("judgment_id").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
    return _judgments(spark, d).select("id").join(k, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("passages")).orderBy(F.desc("passages"), "id").limit(50)


QUERIES, SQL = family.queries, family.sql

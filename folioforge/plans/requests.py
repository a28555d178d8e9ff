"""Requests: browsing by text, provisions named by the query, retrieval policy, spans, pages of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import browse as B
from folioforge.operators import index as I
from folioforge.operators import requests as R
from folioforge.operators import search as S
from folioforge.operators.sequence import first_rows
from folioforge.sources.tables import table

from .browse import _ISO, _J, _judgments
from .registry import Family
from .search import _BM25, _CHUNKS, _chunk_index

family = Family()
_FIELDS = "title, petitioner, respondent, citation, case_number"
_ASK = ["municipal", "board"]


@family.query(
    "WITH " + _J + ", " + _BM25.format(docs=f"SELECT id, concat_ws(' ', {_FIELDS}) body FROM j", terms=_ASK).lstrip()[5:]
    + f" SELECT j.id, score, {_ISO} decided FROM bm JOIN j USING (id) WHERE decision_year >= 1960 ORDER BY score DESC, decided DESC NULLS LAST, j.id LIMIT 20"
)
def browse_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Judgments whose names and numbers hold the words asked for, best first, then latest; filters do not change the scores."""
    j = _judgments(spark, d)
    hits = S.bm25(j, "id", F.concat_ws(" ", *_FIELDS.split(", ")), _ASK, keep=["decision_date"], only=F.col("decision_year") >= 1960)
    return hits.select("id", "score", B.iso_date(F.col("decision_date")).alias("decided")).orderBy(F.desc("score"), F.desc_nulls_last("decided"), "id").limit(20)


_BOOSTS = {"title": (18.0, 5.0), "petitioner": (12.0, 4.0), "respondent": (12.0, 4.0), "citation": (15.0, 6.0), "neutral_citation": (15.0, 6.0), "case_number": (15.0, 6.0)}


def _w(f: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({f}, '')), '[\p{{L}}\p{{N}}]+')"


@family.query(
    f"WITH {_J}, b AS (SELECT judgment_id id, string_agg(chunk_text, ' ' ORDER BY chunk_id) body FROM (SELECT DISTINCT chunk_id, judgment_id, chunk_text FROM chunks) GROUP BY 1), x AS (SELECT j.*, body FROM j LEFT JOIN b USING (id)), "
    + "s AS (SELECT id, greatest("
    + ", ".join(f"CASE WHEN contains(' ' || array_to_string({_w(f)}, ' ') || ' ', ' municipal board ') THEN {p} ELSE 0 END" for f, (p, _) in _BOOSTS.items())
    + ") + greatest("
    + ", ".join(f"CASE WHEN list_has_all({_w(f)}, ['municipal', 'board']) THEN {a} ELSE 0 END" for f, (_, a) in _BOOSTS.items())
    + f") + CASE WHEN contains(' ' || array_to_string({_w('body')}, ' ') || ' ', ' municipal board ') THEN 8 ELSE 0 END"
    + f" + CASE WHEN regexp_matches(' ' || array_to_string({_w('body')}, ' ') || ' ', ' municipal ([^ ]+ ){{0,2}}board ') THEN 4 ELSE 0 END + CASE WHEN list_has_all({_w('body')}, ['municipal', 'board']) THEN 1.5 ELSE 0 END clause_score FROM x) "
    + "SELECT id, clause_score::DOUBLE clause_score FROM s WHERE clause_score > 0"
)
def browse_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Judgments by the boosts of the clauses that hold, over their fields and the text of their passages."""
    c = table(spark, d, "chunks").select("chunk_id", F.col("judgment_id").alias("id"), "chunk_text").distinct()
    # a judgment's passages together: what the index of judgments holds as one text
    text = c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk_text"))), lambda x: x["chunk_text"]), " ").alias("body"))
    rows = _judgments(spark, d).join(text, "id", "left")
    score = R.boosted(_ASK, {f: b for f, b in _BOOSTS.items()}, "body")
    return rows.select("id", score.alias("clause_score")).where("clause_score > 0")


_LAW = "Clauses 3, 5 and 7 on deprivation of title by the purchaser"
_LAW_TERMS = ["purchaser", "title", "deprived"]
_UNITS = r"""SELECT doc_id || ':' || i id, doc_id, i, regexp_extract(line, '^\((\d{1,3})\) ', 1) number, line body FROM (
  SELECT doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) i FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents WHERE source = 'statute_texts' AND text IS NOT NULL)) WHERE trim(line) <> ''"""


@family.query(
    _BM25.format(docs=_UNITS, terms=_LAW_TERMS)
    + f""", un AS ({_UNITS}), nf AS (SELECT id, number, doc_id, i, row_number() OVER (PARTITION BY number ORDER BY doc_id, i) n FROM un WHERE number IN ('3', '5', '7')),
di AS (SELECT id unit_id, 1.0::DOUBLE score, true direct, row_number() OVER (ORDER BY number::INT, doc_id, i) r FROM nf WHERE n <= 12),
kw AS (SELECT id unit_id, score, false direct, row_number() OVER (ORDER BY score DESC, id) r FROM bm ORDER BY score DESC, id LIMIT 100),
a AS (SELECT * FROM di UNION ALL SELECT * FROM kw WHERE unit_id NOT IN (SELECT unit_id FROM di))
SELECT unit_id, score, direct FROM a ORDER BY direct DESC, r LIMIT 40"""
)
def legal_search(spark: SparkSession, d: str) -> DataFrame:
    """Provisions of statutes: those that the query names first, twelve of a number at most, then the best ones for its words."""
    docs = table(spark, d, "documents").where("source = 'statute_texts' AND text IS NOT NULL")
    u = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.trim("line") != "").withColumn("i", F.col("p") + 1)
    u = u.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("unit_id"), "doc_id", "i", F.regexp_extract("line", r"^\((\d{1,3})\) ", 1).alias("number"), "line")
    named = first_rows(u.where(F.col("number").isin(R.direct_numbers(_LAW, "clause"))), ["number"], [F.col("doc_id"), F.col("i")], 12)
    ranked = S.ranked(S.bm25(u, "unit_id", F.col("line"), _LAW_TERMS), [F.desc("score"), F.asc("unit_id")], R.candidate_limit(40))
    return R.direct_first(named, ranked, "unit_id", [F.col("number").cast("int"), F.col("doc_id"), F.col("i")], 40)


_TERMS = ["compensation", "possession"]


@family.query(
    _BM25.format(docs=_CHUNKS, terms=_TERMS)
    + """, k AS (SELECT bm.id chunk_id, c.judgment_id, score, row_number() OVER (ORDER BY score DESC, bm.id) r FROM bm JOIN (SELECT DISTINCT chunk_id, judgment_id FROM chunks) c ON c.chunk_id = bm.id ORDER BY r LIMIT 100),
g AS (SELECT *, row_number() OVER (PARTITION BY judgment_id ORDER BY r) n FROM k)
SELECT chunk_id, judgment_id, score, true widened FROM g WHERE n <= 2 ORDER BY r LIMIT 12"""
)
def retrieval_widened(spark: SparkSession, d: str) -> DataFrame:
    """Years that leave nothing are given up; two passages of a judgment at most."""
    index = _chunk_index(spark, d)

    def search(query: str, years: tuple | None) -> DataFrame:
        only = None if years is None else F.expr("try_cast(substr(decision_date, 1, 4) AS INT)").between(*years)
        return S.ranked(I.bm25(index, query.split(), only=only).select("chunk_id", "judgment_id", "score"), [F.desc("score"), F.asc("chunk_id")], 100)

    q = " ".join(_TERMS)
    hits, widened = R.retrieve(search, q, q, (1800, 1801), "judgment_id", "chunk_id", 12, 2)
    return hits.select("chunk_id", "judgment_id", "score", F.lit(widened).alias("widened"))


@family.query("""
SELECT doc_id, len(string_split(lower(text), 'lease')) - 1 n, CASE WHEN contains(lower(text), 'lease') THEN strpos(lower(text), 'lease') - 1 END first_at,
  CASE WHEN contains(lower(text), 'lease') THEN length(text) - length(string_split(lower(text), 'lease')[-1]) - 5 END last_at FROM documents WHERE text IS NOT NULL""")
def find_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where a word stands in each text: how often, first and last."""
    s = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", R.spans(F.col("text"), "lease").alias("at"))
    return s.select("doc_id", F.size("at").cast("long").alias("n"), F.get("at", F.lit(0)).cast("long").alias("first_at"), F.when(F.size("at") > 0, F.element_at("at", -1)).cast("long").alias("last_at"))


@family.query("SELECT name FROM judges ORDER BY name, id LIMIT 10 OFFSET (SELECT (greatest(1, ceil(count(*) / 10.0)) - 1)::INT * 10 FROM judges)")
def clamped_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 99 of a shorter list is its last."""
    return R.clamped_page(table(spark, d, "judges"), [F.col("name"), F.col("id")], 99).select("name")


@family.query(f"WITH {_J} SELECT id FROM j WHERE " + " OR ".join(f"coalesce(contains(lower({c}), 'mining co'), false)" for c in ("petitioner", "respondent", "title")))
def browse_holds_any(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).where(R.holds_any(["petitioner", "respondent", "title"], "Mining Co")).select("id")


QUERIES, SQL = family.queries, family.sql

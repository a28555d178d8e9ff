"""Retrieval: lexical, vector, fused, by title, by phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import index as I
from folioforge.operators import search as S
from folioforge.sources.tables import table

from .registry import Family

family = Family()
TERMS = ["compensation", "possession", "lease", "tribunal"]
YEARS = (1980, 2005)

_BM25 = r"""
WITH docs AS ({docs}),
w AS (SELECT *, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') t FROM docs WHERE body IS NOT NULL),
s AS (SELECT count(*) n, avg(len(t)) a FROM w),
q AS (SELECT unnest({terms}) term),
h AS (SELECT w.id, any_value(len(w.t)) l, q.term, sum(len(list_filter(w.t, lambda x: x = q.term))) tf FROM w, q WHERE list_contains(w.t, q.term) GROUP BY w.id, q.term),
f AS (SELECT term, count(*) df FROM h GROUP BY term),
bm AS (SELECT h.id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.l / s.a))), 6) score
  FROM h JOIN f USING (term), s GROUP BY h.id)"""
_DOCS = "SELECT doc_id id, text body FROM documents"
_CHUNKS = "SELECT DISTINCT chunk_id id, chunk_text body FROM chunks"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "judgment_id", "title", "citation", "decision_date", "chunk_text", "pdf_page", "paragraph_number").dropDuplicates(["chunk_id"])


def _doc_index(spark: SparkSession, d: str) -> I.Index:
    return I.stored(table(spark, d, "documents").select("doc_id", "text"), "documents", "doc_id", F.col("text"))


def _chunk_index(spark: SparkSession, d: str) -> I.Index:
    """Of the served passages, once per id, with what a hit is filtered and collapsed by."""
    c = _chunks(spark, d).select("chunk_id", "judgment_id", "decision_date", "chunk_text")
    return I.stored(c, "chunks", "chunk_id", F.col("chunk_text"), ("judgment_id", "decision_date"))


def _bm25_docs(spark: SparkSession, d: str, most: int = 80) -> DataFrame:
    return S.ranked(I.bm25(_doc_index(spark, d), TERMS), [F.desc("score"), F.asc("doc_id")], most)


@family.query(_BM25.format(docs=_DOCS, terms=TERMS) + " SELECT id doc_id, score, row_number() OVER (ORDER BY score DESC, id) \"rank\" FROM bm ORDER BY score DESC, id LIMIT 80")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_docs(spark, d)


@family.query(
    _BM25.format(docs=_CHUNKS, terms=TERMS)
    + f""", f2 AS (SELECT id, score FROM bm WHERE id IN (SELECT chunk_id FROM chunks WHERE try_cast(substr(decision_date, 1, 4) AS INT) BETWEEN {YEARS[0]} AND {YEARS[1]}))
SELECT id chunk_id, score, row_number() OVER (ORDER BY score DESC, id) "rank" FROM f2 ORDER BY score DESC, id LIMIT 80"""
)
def bm25_year_filter(spark: SparkSession, d: str) -> DataFrame:
    """The years filter the hits; the scores are those of the whole index."""
    years = F.expr("try_cast(substr(decision_date, 1, 4) AS INT)").between(*YEARS)
    return S.ranked(I.bm25(_chunk_index(spark, d), TERMS, only=years).select("chunk_id", "score"), [F.desc("score"), F.asc("chunk_id")], 80)


@family.query(
    _BM25.format(docs=_CHUNKS, terms=TERMS)
    + """, g AS (SELECT bm.id, bm.score, c.judgment_id, row_number() OVER (PARTITION BY c.judgment_id ORDER BY bm.score DESC, bm.id) r
  FROM bm JOIN (SELECT DISTINCT chunk_id, judgment_id FROM chunks) c ON c.chunk_id = bm.id)
SELECT id chunk_id, judgment_id, score FROM g WHERE r = 1"""
)
def bm25_collapse(spark: SparkSession, d: str) -> DataFrame:
    hits = I.bm25(_chunk_index(spark, d), TERMS)
    return S.collapse(hits, "judgment_id", [F.desc("score"), F.asc("chunk_id")]).select("chunk_id", "judgment_id", "score")


@family.query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term FROM documents)
SELECT term, count(DISTINCT doc_id) df, count(*) cf FROM p GROUP BY term""")
def index_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _doc_index(spark, d).terms()


_TITLE = "Municipal Board v. Collector"
_TITLE_WORDS = ["municipal", "board", "collector"]


@family.query(_BM25.format(docs=_DOCS, terms=TERMS) + " SELECT id doc_id, score FROM bm")
def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """All scores without an index: two scans and one row of statistics."""
    return S.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), TERMS)


@family.query(rf"""
WITH t AS (SELECT DISTINCT id, title, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {tuple(T.TITLE_STOPS)}) w,
  list_filter(regexp_extract_all(lower(title || ' ' || coalesce(citation, '')), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {tuple(T.TITLE_STOPS)}) b FROM judgments WHERE title IS NOT NULL),
u AS (SELECT id, title, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') w, list_distinct(b) b FROM t),
s AS (SELECT id, title, len(list_intersect(b, {_TITLE_WORDS})) / 3.0 + CASE WHEN w = '{" ".join(_TITLE_WORDS)}' THEN 0.5 WHEN contains(w, '{" ".join(_TITLE_WORDS)}') OR contains('{" ".join(_TITLE_WORDS)}', w) THEN 0.2 ELSE 0 END x FROM u),
d AS (SELECT DISTINCT id, title, round(x, 6) title_score FROM s WHERE x >= 0.6)
SELECT * FROM d ORDER BY title_score DESC, id LIMIT 5""")
def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five judgments that a query names best, if it names them well enough."""
    j = table(spark, d, "judgments").select("id", "title", "citation").where("title IS NOT NULL").distinct()
    s = j.select("id", "title", F.round(T.title_score(_TITLE, F.col("title"), F.col("citation")), 6).alias("title_score"))
    return s.where(F.col("title_score") >= 0.6).distinct().orderBy(F.desc("title_score"), "id").limit(5)


@family.query(rf"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ', ' learned counsel ')")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(S.has_phrase(F.col("text"), ["learned", "counsel"])).select("doc_id")


@family.query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t FROM documents),
p AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) i FROM w)
SELECT DISTINCT a.doc_id FROM p a WHERE a.t[a.i] = 'section' AND list_contains(list_slice(a.t, a.i + 1, a.i + 3), 'of')""")
def slop_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(S.has_phrase(F.col("text"), ["section", "of"], slop=2)).select("doc_id").distinct()


@family.query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(t) + 1)) i, t FROM w),
a AS (SELECT doc_id, i FROM p WHERE t[i] = 'section'), b AS (SELECT doc_id, i FROM p WHERE t[i] = 'of'), c AS (SELECT doc_id, i FROM p WHERE t[i] = 'act')
SELECT DISTINCT a.doc_id FROM a JOIN b USING (doc_id) JOIN c USING (doc_id) WHERE a.i < b.i AND b.i < c.i AND c.i - a.i - 2 <= 4""")
def slop_match_three(spark: SparkSession, d: str) -> DataFrame:
    """Three words with four others between them altogether."""
    return table(spark, d, "documents").where(S.has_phrase(F.col("text"), ["section", "of", "act"], slop=4)).select("doc_id").distinct()


@family.query(rf"""
SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), {TERMS})) matched FROM documents
WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), {TERMS})) >= floor(0.65 * 4)""")
def msm_match(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", S.matched_terms(F.col("text"), TERMS).alias("matched"))
    return m.where(F.col("matched") >= int(0.65 * len(TERMS)))


_STEM = "(ations|ation|ings|ing|ed|es|s)$"
_BOOL = ["learned", "counsel", "possession"]
_BOOL_STEMS = ["learn", "counsel", "possession"]


@family.query(rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(list_intersect(list_distinct(t), {_BOOL})) n, contains(' ' || array_to_string(t, ' ') || ' ', ' {" ".join(_BOOL[:2])} ') p,
  len(list_intersect(list_distinct(list_transform(t, lambda x: regexp_replace(x, '{_STEM}', ''))), {_BOOL_STEMS})) s FROM w)
SELECT doc_id, (8.0 * p::INT + 3.0 * (n = 3)::INT + 1.5 * (n >= 1)::INT + 1.0 * (s >= 1)::INT)::DOUBLE clause_score FROM m WHERE p OR n >= 1 OR s >= 1""")
def boolean_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Weighted clauses: phrase 8, all terms 3, 65 % of them 1.5, 60 % of their stems 1; at least one must hold."""
    w = T.words(F.col("text"))
    n = S.matched_terms(F.col("text"), _BOOL)
    stems = F.transform(w, lambda x: F.regexp_replace(x, _STEM, ""))
    s = F.size(F.array_intersect(stems, F.array(*map(F.lit, _BOOL_STEMS))))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", n.alias("n"), s.alias("s"), S.has_phrase(F.col("text"), _BOOL[:2]).alias("p"))
    score = 8.0 * F.col("p").cast("int") + 3.0 * (F.col("n") == 3).cast("int") + 1.5 * (F.col("n") >= 1).cast("int") + 1.0 * (F.col("s") >= 1).cast("int")
    return rows.where("p OR n >= 1 OR s >= 1").select("doc_id", score.alias("clause_score"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


_KNN = """
WITH q AS (SELECT embedding::DOUBLE[] v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v))), 6) similarity FROM embeddings, q {where})"""


@family.query(_KNN.format(where="") + ' SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) "rank" FROM s ORDER BY similarity DESC, vec_id LIMIT 80')
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 80)


@family.query(_KNN.format(where="WHERE label IN (1, 3, 5)") + ' SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) "rank" FROM s ORDER BY similarity DESC, vec_id LIMIT 80')
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 80, F.col("label").isin(1, 3, 5))


@family.query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 valid FROM embeddings")
def vectors_valid(spark: SparkSession, d: str) -> DataFrame:
    """Size, finiteness and unit length of every vector."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").select("vec_id", ((F.size(v) == 64) & finite & (F.abs(norm - 1) <= 0.001)).alias("valid"))


_FUSED = (
    _BM25.format(docs=_DOCS, terms=TERMS)
    + """, kw AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) r FROM bm ORDER BY score DESC, id LIMIT 80),
qv AS (SELECT embedding::DOUBLE[] v FROM embeddings WHERE vec_id = 0),
sm AS (SELECT vec_id id, round(list_dot_product(embedding::DOUBLE[], qv.v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv.v, qv.v))), 6) similarity FROM embeddings, qv),
se AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) r FROM sm ORDER BY similarity DESC, id LIMIT 80),
fu AS (SELECT coalesce(kw.id, se.id) doc_id, kw.r first_rank, se.r second_rank, round(coalesce(1.0 / (60 + kw.r), 0) + coalesce(1.0 / (60 + se.r), 0), 9) rrf FROM kw FULL JOIN se ON kw.id = se.id)"""
)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    sem = S.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 80).withColumnRenamed("vec_id", "doc_id")
    return S.fuse(_bm25_docs(spark, d), sem, "doc_id")


@family.query(_FUSED + """, top AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, first_rank NULLS LAST, second_rank NULLS LAST, doc_id) "rank" FROM fu ORDER BY "rank" LIMIT 10)
SELECT "rank", doc_id, rrf, first_rank, second_rank, source, n_chars FROM top JOIN documents USING (doc_id)""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Fused top 10; the documents are read for those ten only."""
    top = S.ranked(_fused(spark, d), S.fused_order("doc_id"), 10)
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.join(F.broadcast(top), "doc_id").select("rank", "doc_id", "rrf", "first_rank", "second_rank", "source", "n_chars")


@family.query(_FUSED + """, head AS (SELECT * FROM fu ORDER BY rrf DESC, first_rank NULLS LAST, second_rank NULLS LAST, doc_id LIMIT 40)
SELECT doc_id, rrf, strftime(created_at, '%Y-%m-%d %H:%M:%S') created FROM head JOIN documents USING (doc_id) ORDER BY created_at DESC NULLS LAST, rrf DESC, doc_id LIMIT 10""")
def hybrid_recent(spark: SparkSession, d: str) -> DataFrame:
    """The latest ten of the over-fetched fused head, not of the corpus."""
    head = _fused(spark, d).orderBy(*S.fused_order("doc_id")).limit(40)
    docs = table(spark, d, "documents").select("doc_id", "created_at")
    rows = docs.join(F.broadcast(head), "doc_id").orderBy(F.desc_nulls_last("created_at"), F.desc("rrf"), "doc_id").limit(10)
    return rows.select("doc_id", "rrf", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


_ASK = "What is the burden of proving possession under the lease when compensation is claimed?"
_ASK_TERMS = T.question_terms(_ASK)


@family.query(
    "SELECT doc_id, round("
    + " + ".join(f"100 * contains(lower(text), '{t}')::INT" for t in _ASK_TERMS)
    + " + least(length(text), 2400) / 40.0 - 180 * (length(text) < 120)::INT, 6) passage_score FROM documents WHERE text IS NOT NULL"
)
def passage_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(T.passage_score(F.col("text"), _ASK_TERMS), 6).alias("passage_score"))


QUERIES, SQL = family.queries, family.sql

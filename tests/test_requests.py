import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions.text import words
from folioforge.operators import curation as C
from folioforge.operators import index as I
from folioforge.operators import requests as R
from folioforge.operators import search as S
from folioforge.sources import shards as H


def test_index(spark, tmp_path):
    rows = [(1, "the lease of the land", "a"), (2, "land and lease and land", "b"), (3, None, "b"), (4, "nothing of it", None), (5, "", "c")]
    df = spark.createDataFrame(rows, "id int, t string, g string")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    ix = I.build(df, "id", F.col("t"), str(tmp_path / "ix"), ("g",), 4)
    key = lambda d: sorted((r.id, r.score) for r in d.collect())
    assert key(I.bm25(ix, ["land", "lease"])) == key(S.bm25(df, "id", F.col("t"), ["land", "lease"]))
    assert key(I.bm25(ix, ["land"], only=F.col("g") == "b")) == key(S.bm25(df, "id", F.col("t"), ["land"], only=F.col("g") == "b"))
    assert I.bm25(ix, ["absent"]).count() == 0
    plan = ix.postings(["land"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "In(term, [land]" in plan or "EqualTo(term,land)" in plan
    assert df.select(F.sum(F.size(words(F.col("t"))))).first()[0] == ix.terms().agg(F.sum("cf")).first()[0]


def test_direct_and_rewrite():
    assert R.direct_numbers("Under clauses 3, 5 & 7 and clause 5", "clause") == ["3", "5", "7"]
    assert R.direct_numbers("no number", "clause") == [] and R.candidate_limit(12) == 60 and R.candidate_limit(1) == 40 and R.candidate_limit(30) == 100
    x = R.rewrite("find petitoner v. State under the NDPS", [("petitoner", "petitioner")], [("NDPS", "NDPS", "Narcotic Drugs Act")])
    assert x["corrected"] == "find petitioner v. State under the NDPS" and x["corrections"] == [("petitoner", "petitioner")]
    assert x["acronyms"] == [("NDPS", "Narcotic Drugs Act")] and x["case_name"] == "petitoner v. State under the NDPS" and x["enriched"].endswith("Narcotic Drugs Act")
    assert R.rewrite("", [], [])["case_name"] is None


def test_retrieve(spark):
    hits = spark.createDataFrame([("c1", "j", 3.0, 1), ("c2", "j", 2.0, 2), ("c3", "k", 1.0, 3)], "id string, g string, score double, rank int")
    other = spark.createDataFrame([("c1", "j", 3.0, 1), ("d1", "m", 2.5, 2)], "id string, g string, score double, rank int")
    search = lambda q, years: hits.limit(0) if years else (hits if q == "a" else other)
    got, widened = R.retrieve(search, "a", "a", (1, 2), "g", "id", 10, 1)
    assert widened and [r.id for r in got.collect()] == ["c1", "c3"]
    got, widened = R.retrieve(search, "a", "b", None, "g", "id", 10, 2)
    assert not widened and [r.id for r in got.collect()] == ["c1", "c2", "c3", "d1"]
    got, widened = R.retrieve(search, "a", "a", (1, 2), "g", "id", 10, 1, widen=False)
    assert not widened and got.count() == 0


def test_spans(spark):
    df = spark.createDataFrame([("a Lease, lease+leases",), ("",), (None,), ("none",)], "t string")
    assert [r.s for r in df.select(R.spans(F.col("t"), "lease").alias("s")).collect()] == [[2, 9, 15], [], None, []]


def test_names_and_reconcile(spark):
    assert C.equivalent_names("A. B. Rao", "A B RAO") and C.equivalent_names("Anil Rao", "A. Rao") and C.equivalent_names("José Díaz", "Jose Diaz")
    assert not C.equivalent_names("A. Rao", "B. Rao") and not C.equivalent_names("", "Rao") and not C.equivalent_names("Anil Rao", "Anil Sen")
    s = "id int, judges array<string>, authors array<string>, case_number string"
    up = spark.createDataFrame([(1, ["A. Rao", "B. Sen"], ["A. Rao"], "1/90"), (2, ["A. Rao"], [], None), (3, ["A. Rao"], None, "3/90")], s)
    op = spark.createDataFrame([(1, ["B Sen", "A Rao"], ["B Sen"], None), (2, ["C Das"], [], "2/90")], s)
    got = {r.id: r for r in C.reconciled(up, op, "id").collect()}
    assert got[1].judges == ["B Sen", "A Rao"] and got[1].case_number == "1/90" and got[1].warnings == ["upstream_author_marker_disagrees_with_pdf"]
    assert got[2].judges == ["A. Rao"] and got[2].case_number == "2/90" and got[2].warnings == ["ocr_coram_mismatch"]
    assert got[3].judges == ["A. Rao"] and got[3].warnings == []
    w = C.metadata_warnings(F.col("judges"), F.col("authors"), F.lit(3), F.col("case_number"))
    assert up.where("id = 2").select(w.alias("w")).first().w == ["bench_coram_count_mismatch", "missing_case_number"]


def test_overlay_and_upserts(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    over = spark.createDataFrame([(1, None, "new")], "k int, v string, z string")
    assert sorted(map(tuple, C.overlay(base, over, "k").collect())) == [(1, None, "x", "new"), (2, "b", "y", None)]
    new = spark.createDataFrame([(1, "A", "later"), (3, "C", "later")], "k int, v string, w string")
    assert sorted(map(tuple, C.upsert_keeping(base, new, ["k"], "w").collect())) == [(1, "A", "x"), (2, "b", "y"), (3, "C", "later")]


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [
            ("c1", "lawyer_reviewed", "statute", False, ["s1"], ["s2"], ["d1", "d2"]),
            ("c2", "lawyer_reviewed", "code_transition", True, [], [], []),
            ("c3", "draft", "statute", False, ["s1"], [], ["d1"]),
            ("c4", "lawyer_reviewed", "statute", False, ["s1"], [], ["d1"]),
        ],
        "id string, review_status string, category string, must_qualify boolean, required array<string>, acceptable array<string>, relevant array<string>",
    )
    runs = spark.createDataFrame(
        [
            ("c1", ["s1", "s2"], ["d1", "d1", "d9"], ["entailed", "irrelevant", "odd"], ["verified", "hallucinated"], "pass", "fail", "fail"),
            ("c2", ["x"], [], ["partial"], [], None, "pass", "fail"),
            ("c3", [], [], [], [], None, None, None),
        ],
        "case_id string, predicted array<string>, retrieved array<string>, citations array<string>, authorities array<string>, temporal string, insufficient string, transition string",
    )
    total, per = C.evaluation(cases, runs)
    t = total.first()
    assert (t.reviewed, t.scored, t.missing_runs) == (3, 2, 1)
    assert (t.correct_section, t.correct_section_of, t.recall_at_20, t.recall_at_20_of) == (1.0, 1, 0.5, 1)
    assert (t.citation_precision, t.citation_entailment, t.hallucinated_rate, t.answers_hallucinated_rate) == (0.6667, 0.3333, 0.5, 1.0)
    assert (t.temporal, t.insufficient, t.transition) == (1.0, 1.0, 0.0)
    assert {r.case_id: r.status for r in per.collect()} == {"c1": "scored", "c2": "scored", "c4": "missing_run"}
    assert C.evaluation(cases.limit(0), runs)[0].first().correct_section is None


def test_vector_shards(spark, tmp_path):
    v = np.eye(3, 4, dtype=np.float32) * np.array([[1], [2], [1.0005]], np.float32)
    np.savez(tmp_path / "a.npz", ids=np.array(["x", "y", "z"]), vectors=v)
    got = H.vector_shards(spark, str(tmp_path), 4).orderBy("place").collect()
    assert [r.id for r in got] == ["x", "y", "z"] and got[1].vector == [0, 1, 0, 0] and got[2].vector[2] == pytest.approx(1.0005)
    np.savez(tmp_path / "b.npz", ids=np.array(["x"]), vectors=np.zeros((1, 4), np.float32))
    with pytest.raises(Exception, match="no length"):
        H.vector_shards(spark, str(tmp_path), 4).collect()


def test_pages_and_copies(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<doc><page number="1"><fontspec id="0" size="9" family="Times"/><text top="5" left="1" width="10" height="2" font="0">A <b>bold</b></text><text top="9" font="7"/></page></doc>')
    got = H.positioned_pages(spark, str(tmp_path)).orderBy("place").collect()
    assert (got[0].text, got[0].font, got[0].size, got[0].top) == ("A bold", "Times", 9.0, 5.0) and got[1].font is None and got[1].text == ""
    df = spark.createDataFrame([(1, "---\ntitle: 'A v. B'\n---\n# Facts\n\nOne\ntwo.\n\nThree."), (2, None), (3, "plain")], "id int, t string")
    got = H.marked_copies(df, "id", "t").orderBy("id", "block").collect()
    assert [(r.id, r.block, r.heading, r.text) for r in got] == [("1", 0, "Facts", "One two."), ("1", 1, "Facts", "Three."), ("3", 0, None, "plain")]
    assert got[0].fields == {"title": "A v. B"}
    v = spark.createDataFrame([("v2",)], "schema string")
    assert H.versioned(v, "schema", "v2").count() == 1
    with pytest.raises(Exception, match="schema is not v1"):
        H.versioned(v, "schema", "v1").collect()


def test_streams_and_records(spark, tmp_path):
    assert list(H.decoded_lines([b'{"a": 1}\n{"a"', b": 2}\n\n"])) == [{"a": 1}, {"a": 2}]
    assert list(H.decoded_lines([b'event: x\ndata: {"a"', b": 3}\n\ndata: [DONE]\n"], events=True)) == [{"a": 3}]
    df = spark.createDataFrame([("x", [1.0, 2.0], 1990, None), ("y", [0.0, 1.0], None, "t")], "id string, v array<double>, year int, title string")
    assert [r.value for r in H.vector_records(df, "id", "v", ["year", "title"]).collect()] == ['{"id":"x","values":[1.0,2.0],"metadata":{"year":1990}}', '{"id":"y","values":[0.0,1.0],"metadata":{"title":"t"}}']
    H.fan_out(df, "id", str(tmp_path / "f"), spark.createDataFrame([("x",)], "id string"))
    assert [p.name for p in (tmp_path / "f").iterdir() if p.is_dir()] == ["id=x"]

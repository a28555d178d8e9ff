import datetime as dt

import pytest

from folioforge.operators.orphans import orphan_counts, orphan_rows
from folioforge.operators.packed import split_packed

T = dt.datetime

CASES = {
    None: [],
    "": [],
    "  ": [],
    "N/A": [],
    "-": [],
    "ENG": ["ENG"],
    "ENG ": ["ENG"],
    "[PUN]": ["PUN"],
    "[]": [],
    '["MAL", "ASM"]': ["MAL", "ASM"],
    "['English', 'Odia']": ["English", "Odia"],
    "{ENG,ASM,ENG}": ["ENG", "ASM", "ENG"],
    'HIN, "Punjabi, Gurmukhi script", URD': ["HIN", "Punjabi, Gurmukhi script", "URD"],
    '"Urdu, ""Nastaliq"" print";tamil': ['Urdu, "Nastaliq" print', "tamil"],
    "ENG; Punjabi (Gurmukhi, revised)": ["ENG", "Punjabi (Gurmukhi, revised)"],
    "Punjabi (Gurmukhi, revised)": ["Punjabi (Gurmukhi, revised)"],
    "ASM ENG": ["ASM", "ENG"],
    "Hill Nepali, ENG": ["Hill Nepali", "ENG"],
    "ENG\nMAR\tODI": ["ENG", "MAR", "ODI"],
    "A, B and C": ["A", "B", "C"],
    "A & B": ["A", "B"],
    "Sandy, Andra": ["Sandy", "Andra"],
    ";A,,B; ,C": ["A", "B", "C"],
    "A、B，C · D": ["A", "B", "C", "D"],
    'A, "B': ["A", '"B'],
    "Ma'am, B": ["Ma'am", "B"],
    "0, B": ["0", "B"],
    "x" * 5000 + ",y": ["x" * 5000, "y"],
}


def test_packed(spark):
    rows = [(i, k, "other") for i, k in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, langs string, value string")
    got = {}
    for r in split_packed(df, "langs", ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, k, _ in rows:
        assert got.get(i, []) == [(n + 1, v) for n, v in enumerate(CASES[k])], k
    assert split_packed(df.limit(0), "langs", ["id"]).count() == 0


def orphans(spark, stage, parents, gone, **kw):
    s = spark.createDataFrame(stage, "id string, judgment_id string, at timestamp, row_id string")
    p = spark.createDataFrame(parents, "id string, ingested_at timestamp, key string")
    g = spark.createDataFrame(gone, "judgment_id string")
    return orphan_rows([("s", s, "id", "judgment_id", "at")], (p, "id", "ingested_at"), (g, "judgment_id"), **kw)


@pytest.mark.parametrize("kw", [{}, {"range_parents": 2, "batch_rows": 2, "sample_keys": 100}, {"range_parents": 1, "batch_rows": 1, "sample_keys": 40}])
def test_orphans(spark, kw):
    t1, t2 = T(2024, 1, 5), T(2024, 2, 5)
    stage = [("a", " MJ-1 ", t2, "x"), ("b", "mj-2", t1, "x"), ("c", "MJ-3", t1, "x"), ("d", None, t1, "x"), ("e", "MJ-9", None, "x"), ("e", "MJ-9", None, "x"), ("f", "MJ-2", None, "x"), ("g", "", t1, "x")]
    parents = [("MJ-1", t2, "k"), ("MJ-1", t1, "k"), ("MJ-2", t2, "k"), ("MJ-5", None, "k"), ("MJ-6", t1, "k"), (None, t1, "k")]
    got = sorted(map(tuple, orphans(spark, stage, parents, [("mj-3",), ("MJ-1",)], **kw).collect()), key=str)
    want = [("s", "b", "2024-01", "late"), ("s", "c", "2024-01", "deleted"), ("s", "e", None, "missing"), ("s", "e", None, "missing"), ("s", "g", "2024-01", "missing")]
    assert got == want
    assert orphan_counts(orphans(spark, stage, parents, [], **kw)).count() == 3


def test_orphans_empty(spark):
    assert orphans(spark, [], [], []).count() == 0
    assert orphans(spark, [("a", "k", T(2024, 1, 1), "x")], [], []).count() == 1


def test_orphans_hot_key(spark):
    stage = [(str(i), "HOT" if i % 3 else f"k{i}", T(2024, 3, 1), "x") for i in range(900)]
    parents = [(f"k{i}", T(2024, 1, 1), "k") for i in range(0, 900, 6)]
    got = orphans(spark, stage, parents, [], range_parents=20, batch_rows=50)
    assert got.count() == 600 + 150

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("folioforge.llm")
from folioforge.llm import chunking as C

WORDS = "court held that the appeal was filed in time and no order as to costs is made hereby".split()


def text(n, seed, every=11):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + str(r.randint(0, 99))
        out.append(w + "." if i % every == every - 1 else w.capitalize() if i % every == 0 else w)
    return " ".join(out)


def check(t, limit, overlap):
    cuts = C.cut_points(t, limit, overlap)
    words = t.split()
    at = 0
    for k, (a, e, n, shared) in enumerate(cuts):
        piece = t[a:e].split()
        assert len(piece) == n <= limit or len(cuts) == 1
        if k:
            assert (shared > 0) == (overlap > 0) and shared < limit and piece[:shared] == words[at - shared : at]
        assert piece[shared:] == words[at : at + n - shared] and (n > shared or not words)
        at += n - shared
    assert at == len(words)
    return cuts


def test_pieces_cover_and_pause():
    for seed in range(5):
        t = text(2000, seed)
        cuts = check(t, 220, 30)
        assert len(cuts) > 8
        assert all(t[a:e].endswith(".") for a, e, _, _ in cuts[:-1])
        assert all(20 <= s <= 40 for _, _, _, s in cuts[1:])


def test_edit_is_local():
    t = text(4000, 3)
    w = t.split()
    w[2000] = "edited"
    before, after = ({u[a:e] for a, e, _, _ in C.cut_points(u, 220, 30)} for u in (t, " ".join(w)))
    assert len(before - after) <= 4


def test_abbreviations_do_not_end_sentences():
    s = "Rao v. State of X. The sum of Rs. 500 was paid to Dr. Sen. It was late."
    spans = [m.span() for m in C._WORD.finditer(s)]
    ends = [s[a:b] for (a, b), r in zip(spans, C.pauses(s, spans)) if r == 3]
    assert ends == ["X.", "Sen."] or ends == ["Sen."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "C", "d,", "e;", "\n\n", "x" * 50]), max_size=300), st.integers(4, 40))
def test_any_text(parts, limit):
    check(" ".join(parts), limit, limit // 5)


def test_table(spark):
    rows = [
        ("j:p0001:para0001:part01", "j", 1, 1, 1, text(500, 1), "x"),
        ("j:p0001:para0001:part01", "j", 1, 1, 1, text(500, 1), "x"),
        ("j:p0001:para0001:part02", "j", 1, 1, 2, "short text", "x"),
        ("k:p0001:para0001:part01", None, None, None, None, "", "x"),
        ("l", None, None, None, None, None, "x"),
        (None, None, None, None, None, text(221, 2), "x"),
    ]
    df = spark.createDataFrame(rows, "id string, judgment_id string, pdf_page int, paragraph_index int, part_index int, text string, piece string")
    got = C.search_chunks(df)
    j = sorted(r.part_index for r in got.where("judgment_id = 'j'").collect())
    assert j == list(range(1, len(j) + 1)) and len(j) >= 4
    assert got.where("judgment_id = 'j' AND n_words > 220").count() == 0
    assert got.where("text = 'short text'").first().part_index == len(j)
    assert [r.id for r in C.oversized_ids(df, "id", "text").collect()] == ["j:p0001:para0001:part01"]
    assert C.search_chunks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.pieces(df, "text", ["id"], 20, 10)

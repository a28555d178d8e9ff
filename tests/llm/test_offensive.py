import os
import random

import pytest

pytest.importorskip("folioforge.llm")
from folioforge.llm import offensive as O

PLAIN = ["The appeal is dismissed with costs.", "The tenant was examined at the hearing.", "Thanks for posting the headnote.", "The notice was served on the landlord.", "The accused called him a fool in court, it is alleged."]
BAD = {"abuse": ["You are a stupid fool and everyone knows it.", "Shut up, you worthless idiot."], "hate": ["The river folk are animals and should be driven out.", "Never rent to the river folk."], "sexual": ["I want you naked on the floor tonight.", "She moaned as he touched her naked body."]}


def rows(seed, n=120):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = [r.choice(PLAIN) for _ in range(4)]
        label = r.choice(["none", "none", "none", *BAD])
        if label != "none":
            s.insert(r.randint(0, 4), r.choice(BAD[label]))
        out.append((" ".join(s), "none" if r.random() < 0.04 else label, label))
    return out


def test_words():
    assert O.words("You j a c k a s s, cl0wn f00l ѕtuріd!!!") == O.words("you jackass clown fool stupid")
    assert O.words("imbeccile rattts n@ked") == O.words("imbecile rats naked")
    assert O.words("imbécil 1234") == ["imbecil", "0"]
    assert O.words("") == [] and O.sentences("") == []
    assert O.sentences("In Rao v. State it was held. No.") == ["In Rao v. State it was held.", "No."]


def test_probabilities():
    m = O.Model(least=1).fit([["a", "b"], ["a", "c"], ["b"]], [2, 1, 1], O.np.array([0, 3, 3]))
    words = ["a", "b", "c", "</s>", "<unk>", "<s>"]
    from math import exp

    for c in (0, 3):
        assert sum(exp(m._logs(("<s>", "<s>", w))[c]) for w in words) == pytest.approx(1, abs=1e-9)


def test_fit_and_judge():
    m = O.fit([(t, noisy) for t, noisy, _ in rows(1)])
    wrong = 0
    for t, _, label in rows(2):
        got = {O.CLASSES[i] for i in m.judge(t, 0.95)[1]}
        wrong += got != ({label} - {"none"})
    assert wrong <= 4
    assert m.judge("You are a st*pid f00l and everyone knows it!!", 0.95)[1] == {0}


def test_table(spark):
    data = rows(3, 150)
    docs = [(i, t, f"s{i % 2}", "abuse") for i, (t, _, _) in enumerate(data)] + [(900, None, None, "x"), (901, "", "s0", "x"), (902, "The appeal is dismissed with costs. " * 3000 + BAD["hate"][1], "s1", "x")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, found string")
    labels = spark.createDataFrame([(i, n, "r") for i, (_, n, _) in enumerate(data)] + [(3, None, "r"), (4, "unsure", "r"), (None, "abuse", "r")], "doc_id long, label string, text string")
    scored = O.score_documents(documents, labels).cache()
    assert scored.count() == len(docs)
    found = {tuple(r) for r in O.found_categories(scored).collect()}
    want = {(i, lab) for i, (_, _, lab) in enumerate(data) if lab != "none"} | {(902, "hate")}
    assert len(found ^ want) <= 5
    assert scored.where("doc_id IN (900, 901)").selectExpr("max(abuse)", "max(size(found))").first()[:] == (-9.0, 0)
    assert O.source_rates(scored).count() == 3
    assert O.found_categories(O.score_documents(documents, labels.limit(0))).count() == 0
    assert O.score_documents(documents.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out():
    import duckdb

    d = "/root/testdata/sf0.1"
    rows_ = duckdb.sql(f"""SELECT text, mode(label) FROM '{d}/documents.parquet' JOIN '{d}/review_labels.parquet' USING (doc_id)
        WHERE label IN ('none', 'abuse', 'hate', 'sexual') AND text <> '' GROUP BY doc_id, text ORDER BY doc_id""").fetchall()
    model = O.fit(rows_[::2])
    # reviewers err: agreement is asked for, not equality
    ok = [bool(model.judge(t, 0.95)[1]) == (lab != "none") for t, lab in rows_[1::2]]
    assert sum(ok) / len(ok) >= 0.85

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import browse as B
from folioforge.operators import documents as D
from folioforge.operators import merge as M
from folioforge.operators import quality as Q
from folioforge.operators import sampling as A
from folioforge.operators import search as S
from folioforge.operators import sequence as W


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_word_windows(spark):
    text = " ".join(map(str, range(12)))
    assert one(spark, T.word_windows(F.col("t"), 8, 2), t=text) == [" ".join(map(str, range(8))), " ".join(map(str, range(6, 12)))]
    rng = random.Random(1)
    for _ in range(25):
        n, size = rng.randint(1, 60), rng.randint(3, 12)
        overlap = rng.randint(0, size - 1)
        words, want, i = [f"w{k}" for k in range(n)], [], 0
        while True:
            want.append(" ".join(words[i : i + size]))
            if i + size >= n:
                break
            i += size - overlap
        assert one(spark, T.word_windows(F.col("t"), size, overlap), t=" ".join(words)) == want


def test_searchable(spark):
    for t, want in ("440", False), ("s~", False), ("(1962) 1 S.C.R. 123 000000", False), ("The appeal must be allowed.", True):
        assert one(spark, T.searchable(F.col("t")), t=t) is want


def test_paragraphs():
    assert D.split_paragraphs("[1] First line\ncontinues here\n\n2. Second para-\ngraph") == [("1", "First line continues here"), ("2", "Second paragraph")]
    assert D.split_paragraphs("") == []


def test_merge_two():
    assert D.merge_two("a b c d", "c d e f") == "a b c d e f"
    assert D.merge_two("a b", "b c") == "a b b c"


def test_merged_parts(spark):
    df = spark.createDataFrame([("j", 2, "c d e f"), ("j", 1, "a b c d"), ("j", 3, None)], "g string, o int, t string")
    assert D.merged_parts(df, ["g"], "o", "t").first().text == "a b c d e f"


def test_block_kind(spark):
    assert one(spark, D.block_kind(F.col("t")), t="JUDGMENT OF THE COURT") == "heading"
    assert one(spark, D.block_kind(F.col("t")), t="* Reported as amended") == "footnote"
    assert one(spark, D.block_kind(F.col("t")), t="The appeal is allowed.") == "paragraph"


def test_citation_row(spark):
    r = one(spark, D.citation_row(F.col("t")), t="[1970] 2 S.C.R. 100 relied on Para 4(2)")
    assert (r.citation, r.treatment, r.paragraphs) == ("[1970] 2 S.C.R. 100", "relied on", [4, 2])
    assert one(spark, D.citation_row(F.col("t")), t="[1970] 2 S.C.R. 100 relied on and overruled") is None
    assert one(spark, D.citation_row(F.col("t")), t="[1970] 2 S.C.R. 100 not  followed").treatment == "not followed"
    assert one(spark, D.citation_row(F.col("t")), t="[1970] 2 S.C.R. 100 disapproved").treatment == "disapproved"


def test_judges(spark):
    assert one(spark, D.judge_list(F.col("t")), t="Hon'ble Mr. Justice A. Rao, Justice B. Sen and A. Rao") == ["A Rao", "B Sen"]


def test_tags(spark):
    assert one(spark, D.without_tags(F.col("t")), t="<p>A &amp; B<br>C</p><script>x</script>") == "A & B C"


def test_fnv():
    assert D.fnv1a([]) == 0x811C9DC5
    assert f"{D.fnv1a(['a']):08x}" == f"{((((0x811C9DC5 ^ 97) * 0x01000193) & 0xFFFFFFFF)):08x}"


def test_align():
    def brute(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (3 if a[i - 1] == b[j - 1] else -3), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = random.Random(3)
    for _ in range(40):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        pairs = D.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        gaps = sum((q[0] - p[0] - 1) + (q[1] - p[1] - 1) for p, q in zip(pairs, pairs[1:]))
        assert 3 * len(pairs) - gaps <= brute(a, b) if pairs else brute(a, b) == 0
    assert D.align([], ["a"]) == []


def test_sequence_and_lines(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(["1", "5", "2", None, "2", "3"])], "d string, o int, n string")
    assert [r.paragraph for r in D.in_sequence(df, "d", ["o"], "n").orderBy("o").collect()] == [1, 1, 2, 2, 2, 3]
    el = spark.createDataFrame([(1, 10.0), (1, 10.2), (1, 12.0), (2, 10.1)], "page int, top double")
    assert [r.line_no for r in D.clustered_lines(el, ["page"], "top", 0.3).orderBy("page", "top").collect()] == [0, 0, 1, 0]
    by = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 7, 20, 1])], "g string, o int, s int")
    assert [r.batch_no for r in D.byte_batches(by, "g", ["o"], "s", 10).orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_passages(spark):
    t = "zero one two three four five six seven eight nine ten"
    assert one(spark, D.first_match(F.col("a"), F.col("b")), a=t, b="two three four five six seven eight nine") == 2
    assert one(spark, D.first_match(F.col("a"), F.col("b")), a=t, b="nothing of it") is None


def test_answers(spark):
    problem = D.answer_problem(F.col("a"), F.col("k"))
    for a, want in [
        ("The court held that it is void [[c1]].", None),
        ("The court held that it is void.", "nothing cited"),
        ("The court held that it is void [[c9]].", "unknown source"),
        ("# Heading", "no substantive claim"),
        ("The court held it is void [[c1]].\nAnd this claim has no source.", "uncited claim"),
    ]:
        assert one(spark, problem, a=a, k=["c1", "c2"]) == want


def test_gate(spark):
    for q, want in ("forest", "too short"), ("hello there", "greeting"), ("xkcdqrtzvb wrtpsdfg", "senseless"), ("is bail a right", None):
        assert one(spark, D.gate(F.col("q")), q=q) == want
    assert one(spark, D.gate(F.col("q"), True), q="why?") is None


def test_title_score(spark):
    assert one(spark, T.title_score("Rao v. State", F.col("t")), t="Rao v State") == pytest.approx(1.5)
    assert one(spark, T.title_score("Rao v. State", F.col("t")), t="") == pytest.approx(0.2)
    assert one(spark, T.title_score("Rao v. State", F.col("t"), F.lit("[1970] 2 X.R. 9")), t="Rao v State") == pytest.approx(1.5)
    assert one(spark, T.title_score("the state v. union", F.col("t")), t="Rao v State") == 0
    with pytest.raises(ValueError):
        T.query_words("!!")


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(3, 1), (2, 9)], "id int, rank int")
    got = [r.id for r in S.fuse(a, b, "id").orderBy(*S.fused_order("id")).collect()]
    assert got == [2, 1, 3]


def test_phrase(spark):
    assert one(spark, S.has_phrase(F.col("t"), ["a", "b"]), t="x A, b y") is True
    assert one(spark, S.has_phrase(F.col("t"), ["a", "b"]), t="a c b") is False
    assert one(spark, S.has_phrase(F.col("t"), ["a", "b"], 2), t="a c d b") is True
    assert one(spark, S.has_phrase(F.col("t"), ["a", "b"], 2), t="a c d e b") is False
    three = S.has_phrase(F.col("t"), ["a", "b", "c"], 2)
    for t, want in ("a a b x x c", True), ("a b x x c", True), ("a x b x c", True), ("a x x b x c", False), ("b a c", False), ("aa b c", False):
        assert one(spark, three, t=t) is want, t


def test_budgets(spark):
    rng = random.Random(5)
    rows = [("g%d" % rng.randint(0, 3), i, rng.randint(1, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o int, c int")
    got = {r.g: r["items"] for r in W.skipping_budget(df, "g", "o", "c", ["o"], 70, 5).collect()}
    for g in {r[0] for r in rows}:
        left, kept = 70, []
        for _, o, c in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])[:5]:
            if 0 < c <= left:
                kept.insert(0, str(o))
                left -= c
        assert got[g] == kept
    big = spark.createDataFrame([("a", 1, 99), ("a", 2, 1)], "g string, o int, c int")
    assert W.prefix_budget(big, ["g"], [F.col("o")], F.col("c"), 50).count() == 0
    assert W.prefix_budget(big, ["g"], [F.col("o")], F.col("c"), 50, keep_first=True).count() == 1


def test_budget_looks_at_the_newest(spark):
    # none of the five newest fits: nothing older is looked at
    rows = [("a", i, 99 if i >= 5 else 2) for i in range(10)] + [("b", 1, 3), ("b", 2, 99), ("b", 3, 0)]
    df = spark.createDataFrame(rows, "g string, o int, c int")
    got = {r.g: r["items"] for r in W.skipping_budget(df, "g", "o", "c", ["o"], 70, 5).collect()}
    assert got == {"a": [], "b": ["1"]}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(M.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, None)]
    assert rows(M.insert_missing(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, None)]
    assert rows(M.update_from(old, new, ["k"], ["v"])) == [(1, "a"), (2, "B")]
    assert rows(M.replace_groups(old, new, "k")) == [(1, "a"), (2, "B"), (3, None)]


def test_balanced_sample(spark):
    rng = random.Random(2)
    rows = [(f"d{i}", rng.choice("XYZ"), rng.choice(["s", "m"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, era string, sev string")
    import hashlib

    h = lambda i: hashlib.sha256(f"q:{i}".encode()).hexdigest()
    lists = {}
    for e in "XYZ":
        by = {s: sorted((r for r in rows if r[1] == e and r[2] == s), key=lambda r: (h(r[0]), r[0])) for s in "sm"}
        out = []
        while any(by.values()):
            out += [by[s].pop(0) for s in "sm" if by[s]]
        lists[e] = out
    want, k = [], 0
    while len(want) < 12:
        want += [lists[e][k] for e in "XYZ" if k < len(lists[e])][: 12 - len(want)]
        k += 1
    got = A.balanced_sample(df, "era", "sev", "id", ["s", "m"], 12, "q").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_filters(spark):
    with pytest.raises(ValueError):
        B.Filters(year_from=1700)
    with pytest.raises(ValueError):
        B.Filters(bench_min=5, bench_max=2)
    df = spark.createDataFrame([("a", None), ("b", "ENG, tam"), ("c", "ENGX")], "id string, l string")
    assert [r.id for r in df.where(B.csv_holds(F.col("l"), ["eng"])).collect()] == ["b"]
    assert one(spark, B.iso_date(F.col("t")), t="2020-02-30") is None
    assert one(spark, B.iso_date(F.col("t")), t="2020-02-28") == "2020-02-28"


def test_metrics(spark):
    assert one(spark, Q.recall_at(F.col("f"), F.col("r"), 2), f=["a", "a", "b", "c"], r=["b", "c"]) == 0.5
    assert one(spark, Q.recall_at(F.col("f"), F.col("r"), 2), f=["a"], r=[]) is None
    assert one(spark, Q.exact_set(F.col("p"), F.col("q"), F.col("a")), p=["1", "2"], q=["1"], a=["2"]) is True
    assert one(spark, Q.exact_set(F.col("p"), F.col("q"), F.col("a")), p=["1", "3"], q=["1"], a=["2"]) is False
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, Q.set_difference(a, b).collect())) == [(1, "left"), (2, "left"), (3, "right")]

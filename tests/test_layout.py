from pyspark.sql import functions as F

from folioforge.operators import layout as L


def test_reasons(spark):
    df = spark.createDataFrame([(None, None, None, False), ("x" * 50, 92.0, "boom", True), ("x" * 50, 0.92, None, True), ("x" * 50, 70.0, None, True), ("x", None, None, True)], "t string, c double, e string, p boolean")
    got = [r.w for r in df.select(L.fallback_reasons(F.col("t"), F.col("c"), F.col("e"), F.col("p")).alias("w")).collect()]
    assert got == [["missing"], ["error"], [], ["low confidence"], ["short", "no confidence"]]


def test_choice(spark):
    rows = [
        ("keep", "e", "f", 92.0, 0.8, None, "n", 0.9, None, "embedded"),
        ("ocr", "e", "f" * 50, 92.0, 0.2, None, "n", 0.9, None, "fast"),
        ("ocr", "e", "f" * 50, 60.0, 0.8, None, "n", 0.78, None, "neural"),
        ("ocr", "e", "f" * 50, 60.0, 0.8, None, "n", 0.7, None, "fast"),
        ("reocr", "e", "f", 92.0, 0.8, "boom", "n", 0.1, None, "neural"),
        ("ocr", "e", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a string, e string, f string, fc double, fq double, fe string, n string, nq double, ne string, want string")
    got = df.select(L.chosen_text(*[F.col(c) for c in ("a", "e", "f", "fc", "fq", "fe", "n", "nq", "ne")]).alias("x"), "want").collect()
    assert [r.x.source for r in got] == [r.want for r in got]


def test_route(spark):
    rows = [(3, 3, 0, 0.99, "ocr_required"), (3, 1, 2, 0.9, "reocr_recommended"), (3, 1, 2, 0.96, "selective_ocr_required"), (3, 0, 1, 0.96, "existing_ocr_usable"), (3, 1, 0, 0.5, "selective_ocr_required"), (3, 0, 0, 0.5, "digital_text")]
    df = spark.createDataFrame(rows, "p int, m int, s int, q double, want string")
    assert all(r.x == r.want for r in df.select(L.document_route(*[F.col(c) for c in "pmsq"]).alias("x"), "want").collect())
    pages = spark.createDataFrame([("digital_text", 10, False, "ocr"), ("reocr_recommended", 90, True, "reocr"), ("reocr_recommended", 90, False, "keep")], "r string, n int, s boolean, want string")
    assert all(r.x == r.want for r in pages.select(L.page_action(F.col("r"), F.col("n"), F.col("s")).alias("x"), "want").collect())


def test_margins(spark):
    t = "first line      A\nsecond line      B\nthird      C\nfourth      D"
    df = spark.createDataFrame([(t,), ("a letter A in prose",), ("one      A",), (None,)], "t string")
    got = [r.x for r in df.select(L.without_margin_letters("t").alias("x")).collect()]
    assert got == ["first line\nsecond line\nthird\nfourth", "a letter A in prose", "one      A", None]
    el = spark.createDataFrame([(1, x, 955.0 + i % 2, 100.0 * i, 1000.0, 1000.0) for i, x in enumerate("ABCDE")] + [(1, "A", 300.0, 5.0, 1000.0, 1000.0), (2, "A", 955.0, 1.0, 1000.0, 1000.0)], "p int, t string, l double, y double, h double, w double")
    assert L.gutter_letters(el, ["p"], "t", "l", "y", "h", "w").count() == 5


def test_small(spark):
    df = spark.createDataFrame([("21A",), ("21",), ("371-I",), ("3",)], "c string")
    assert [r.c for r in df.orderBy(L.identifier_key(F.col("c"))).collect()] == ["3", "21", "21A", "371-I"]
    s = spark.sql("SELECT 'abcdef' t, array(named_struct('start', 0, 'end', 2, 'style', 'b'), named_struct('start', 2, 'end', 6, 'style', 'i')) r")
    assert [(x.style, x.text) for x in s.select(L.styled(F.col("t"), F.col("r")).alias("x")).first().x] == [("b", "ab"), ("i", "cdef")]
    assert df.select(L.escaped(F.lit('<a href="x">&')).alias("x")).first().x == "&lt;a href=&quot;x&quot;&gt;&amp;"
    rows = spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0), (3, 1, 6.0), (4, 2, 1.0)], "o int, p int, y double").withColumn("g", F.lit(1))
    assert [r.o for r in L.increasing(rows, ["g"], "o", ["p", "y"]).collect()] == [3]
    assert df.select(L.without_head(F.lit("HEAD " + "x" * 300), F.lit("HEAD")).alias("x")).first().x == "x" * 300
    m = spark.sql("SELECT 'g' g, map('a', 1L) c UNION ALL SELECT 'g', map('a', 2L, 'b', 3L)")
    assert L.merged_counts(m, ["g"], "c").first().c == {"a": 3, "b": 3}

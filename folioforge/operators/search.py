"""Lexical and vector retrieval and their fusion."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import words


def bm25(df: DataFrame, id_col: str, text: Column, terms: list[str], k1: float = 1.2, b: float = 0.75, keep: list[str] = (), only: Column | None = None) -> DataFrame:
    """(id, keep..., score) of every row with one of ``terms``: Okapi BM25, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), 6 places.

    Two scans and one row of statistics between them; nothing is shuffled.
    Null texts are no documents. ``only`` filters the hits; the statistics are those of all rows.
    """
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    t = df.select(id_col, *keep, wanted.alias("wanted"), words(text).alias("w")).where("w IS NOT NULL")
    asked = F.array(*map(F.lit, terms))
    d = t.select(id_col, *keep, "wanted", F.size("w").alias("n"), F.filter("w", lambda x: F.array_contains(asked, x)).alias("hits"))
    stats = d.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_n"), *[F.count_if(F.array_contains("hits", x)).alias(f"df{i}") for i, x in enumerate(terms)])
    hit = d.where("wanted").where(F.size("hits") > 0).crossJoin(F.broadcast(stats))  # one row
    norm = k1 * (1 - b + b * F.col("n") / F.col("avg_n"))

    def part(i: int, x: str) -> Column:
        tf = F.size(F.filter("hits", lambda h: h == x)).cast("double")
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * tf * (k1 + 1) / (tf + norm)

    return hit.select(id_col, *keep, F.round(sum(part(i, x) for i, x in enumerate(terms)), 6).alias("score"))


def ranked(df: DataFrame, order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows by a total order, numbered from 1."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows


def collapse(df: DataFrame, group: str, order: list[Column], most: int = 1) -> DataFrame:
    """The best ``most`` rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def matched_terms(text: Column, terms: list[str]) -> Column:
    """How many of ``terms`` the text holds."""
    return F.size(F.array_intersect(words(text), F.array(*map(F.lit, terms))))


def has_phrase(text: Column, phrase: list[str], slop: int = 0) -> Column:
    """The phrase's words in order, with at most ``slop`` other words between them altogether."""
    w = words(text)
    if slop == 0 or len(phrase) < 2:
        return F.contains(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), F.lit(" " + " ".join(phrase) + " "))
    # every way to spend the slop on the gaps is a branch, so that no match hides another
    spent = [g for g in product(range(slop + 1), repeat=len(phrase) - 1) if sum(g) <= slop]
    ways = ["".join(f"{x} (?:[^ ]+ ){{{n}}}" if n else f"{x} " for x, n in zip(phrase, g)) + phrase[-1] for g in spent]
    return F.array_join(w, " ").rlike(rf"(?<![^ ])(?:{'|'.join(ways)})(?![^ ])")


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine of an array column and a fixed vector, in double precision; null where either has no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(a, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm * float(sum(x * x for x in query)) ** 0.5)


def nearest(df: DataFrame, id_col: str, vector: str, query: list[float], most: int, where: Column | None = None) -> DataFrame:
    """(id, similarity, rank) of the ``most`` nearest rows, filtered before they are measured; ties by id."""
    rows = df if where is None else df.where(where)
    s = rows.select(id_col, F.round(cosine(F.col(vector), query), 6).alias("similarity")).where("similarity IS NOT NULL")
    return ranked(s, [F.desc("similarity"), F.asc(id_col)], most)


def fuse(first: DataFrame, second: DataFrame, id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (id, rrf, first_rank, second_rank), 9 places."""
    a = first.select(id_col, F.col("rank").alias("first_rank"))
    b = second.select(id_col, F.col("rank").alias("second_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, id_col, "full").withColumn("rrf", F.round(part("first_rank") + part("second_rank"), 9))


def fused_order(id_col: str) -> list[Column]:
    """Best first; among equals those of the first list, in its order, then those of the second."""
    return [F.desc("rrf"), F.asc_nulls_last("first_rank"), F.asc_nulls_last("second_rank"), F.asc(id_col)]


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf): the derived index table."""
    return df.select(id_col, F.explode(words(text)).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))

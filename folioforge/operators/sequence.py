"""Operators on ordered rows: caps, budgets, islands, carried labels, repeated heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, group: list[str], order: list[Column], most: int, rank: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group; the group limit runs before the shuffle."""
    name = rank or "__r"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)
    return out if rank else out.drop(name)


def prefix_budget(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int, keep_first: bool = False) -> DataFrame:
    """Rows of each group in order while their costs add up to at most ``budget``; with ``keep_first`` the first stays whatever it costs."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("__sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    fits = F.col("__sum") <= budget
    return out.where(fits | (F.col("__n") == 1) if keep_first else fits).drop("__sum", "__n")


def skipping_budget(df: DataFrame, group: str, item: str, cost: str, order: list[str], budget: int, most: int) -> DataFrame:
    """Of the newest ``most`` items of each group those that still fit the budget, newest first: (group, items in reading order).

    An item that does not fit, or costs nothing, is passed over; a smaller older one among the newest ``most`` may still
    be taken. The group limit runs before the shuffle.
    """
    newest = first_rows(df.where(F.col(cost).isNotNull()), [group], [F.desc(c) for c in order], most)
    rows = F.reverse(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(item).cast("string").alias("i"), F.col(cost).cast("long").alias("c")))))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<string>").alias("a"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x.c > 0) & (acc.s + x.c <= budget)
        return F.struct(F.when(fits, acc.s + x.c).otherwise(acc.s).alias("s"), F.when(fits, F.concat(F.array(x.i), acc.a)).otherwise(acc.a).alias("a"))

    return newest.groupBy(group).agg(rows.alias("r")).select(group, F.aggregate("r", start, step, lambda a: a.a).alias("items"))


def islands(df: DataFrame, group: list[str], order: list[Column], same: Column) -> DataFrame:
    """Number the runs of neighbouring rows with equal ``same``: column ``run`` from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(same.eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def carried(label: Column, group: list[str], order: list[Column]) -> Column:
    """The last label that is not null up to the row."""
    return F.last(label, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def head_print(line: Column) -> Column:
    """A line with digits and all but letters taken away, for comparing running heads."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def repeated_heads(lines: DataFrame, doc: str, page: str, line: str, least: int = 2) -> DataFrame:
    """(doc, print, pages): prints of lines that stand on at least ``least`` pages of one document."""
    p = lines.select(doc, page, head_print(F.col(line)).alias("print")).where("print <> ''")
    return p.groupBy(doc, "print").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least)

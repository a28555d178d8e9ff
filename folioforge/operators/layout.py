"""Page routing, recognition results, geometry of page elements, and their checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def confidence_percent(c: Column) -> Column:
    """A confidence in percent; values up to 1 are shares."""
    return F.when((c > 0) & (c <= 1), c * 100).otherwise(c)


def fallback_reasons(text: Column, confidence: Column, error: Column, present: Column, least: float = 75, signs: int = 40) -> Column:
    """array<string>: why a recognition result is not enough; empty if it is."""
    return F.array_compact(
        F.array(
            F.when(~present, "missing"),
            F.when(present & error.isNotNull(), "error"),
            F.when(present & (F.length(F.trim(F.coalesce(text, F.lit("")))) < signs), "short"),
            F.when(present & confidence.isNull(), "no confidence"),
            F.when(present & (confidence_percent(confidence) < least), "low confidence"),
        )
    )


# Least signs of a page with text, and the score from which a scan's own text is good.
MIN_TEXT = 40
GOOD_SCORE = 0.95


def document_route(pages: Column, missing: Column, scanned: Column, score: Column) -> Column:
    """What a document needs, from its numbers of pages, of pages without text, of scanned pages, and the quality of its whole text."""
    return (
        F.when(missing == pages, "ocr_required")
        .when((scanned > 0) & (score < GOOD_SCORE), "reocr_recommended")
        .when(missing > 0, "selective_ocr_required")
        .when(scanned > 0, "existing_ocr_usable")
        .otherwise("digital_text")
    )


def page_action(route: Column, n_chars: Column, scanned: Column) -> Column:
    """What to do with a page of a document of that route: ocr where there is hardly text, reocr where the scan is to be read again, else keep."""
    return F.when(n_chars < MIN_TEXT, "ocr").when((route == "reocr_recommended") & scanned, "reocr").otherwise("keep")


def chosen_text(action: Column, embedded: Column, fast: Column, fast_c: Column, fast_q: Column, fast_error: Column, neural: Column, neural_q: Column, neural_error: Column, slack: float = 0.03) -> Column:
    """struct(text, source): the embedded text of a page to keep; else the fast one, or the neural where the fast is weak and it is
    hardly worse, or where there is no fast one; null text and source where neither was read."""
    has_fast, has_neural = fast.isNotNull() & fast_error.isNull(), neural.isNotNull() & neural_error.isNull()
    weak = F.size(fallback_reasons(fast, fast_c, fast_error, fast.isNotNull())) > 0
    better = F.coalesce(neural_q, F.lit(0.0)) >= F.coalesce(fast_q, F.lit(0.0)) - slack
    pick = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
    return (
        F.when(action == "keep", pick(embedded, "embedded"))
        .when(has_fast & ~(has_neural & weak & better), pick(fast, "fast"))
        .when(has_neural, pick(neural, "neural"))
        .otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source")))
    )


def bounds(df: DataFrame, group: list[str]) -> DataFrame:
    """(group..., top, left, bottom, right): the box that holds all boxes of a group."""
    return df.groupBy(*group).agg(
        F.min("top").alias("top"), F.min("left").alias("left"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.max(F.col("left") + F.col("width")).alias("right")
    )


def merged_counts(df: DataFrame, group: list[str], counts: str) -> DataFrame:
    """(group..., counts map): the maps of a group added up key by key."""
    each = df.select(*group, F.explode(counts).alias("k", "v")).groupBy(*group, "k").agg(F.sum("v").alias("v"))
    return each.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(counts))


def stable_columns(df: DataFrame, group: list[str], columns: list[str], most: float = 3.0) -> DataFrame:
    """(group..., stable): the distances between neighbouring columns vary by at most ``most`` over the rows of a group."""
    spread = [F.max(F.col(b) - F.col(a)) - F.min(F.col(b) - F.col(a)) for a, b in zip(columns, columns[1:])]
    return df.groupBy(*group).agg(F.greatest(*spread, F.lit(0.0)).alias("s")).select(*group, (F.col("s") <= most).alias("stable"))


def gutter_letters(df: DataFrame, page: list[str], text: str, left: str, top: str, height: str, width: str, least: int = 4) -> DataFrame:
    """Elements that are margin letters A to H: letters at one distance from the edge, at least ``least`` different ones over a quarter of the page.

    Letters are clustered by runs of neighbouring distances, a gap of more
    than 3 or 0.8 % of the page's width begins a new run.
    """
    one = df.where(F.trim(text).rlike("^[A-H]$"))
    w = Window.partitionBy(*page).orderBy(left, top)
    new = F.when(F.col(left) - F.lag(left).over(w) <= F.greatest(F.lit(3.0), F.col(width) * 0.008), 0).otherwise(1)
    runs = one.withColumn("__n", new).withColumn("__run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")
    ok = runs.groupBy(*page, "__run").agg(F.count_distinct(F.trim(text)).alias("k"), (F.max(top) - F.min(top)).alias("span"), F.max(height).alias("h"))
    return runs.join(ok.where((F.col("k") >= least) & (F.col("span") >= 0.25 * F.col("h"))), [*page, "__run"], "left_semi").drop("__run")


_TAIL = re.compile(r"(?<=\S)\s{3,}([A-H])\s*$|^\s*([A-H])\s{3,}(?=\S)")


@F.pandas_udf(StringType())
def without_margin_letters(text: pd.Series) -> pd.Series:
    """Letters A to H set off by blanks at line ends, where at least four stand in order; otherwise the text stays."""

    def one(t):
        if t is None:
            return None
        lines = t.split("\n")
        found = [m[1] or m[2] for m in map(_TAIL.search, lines) if m]
        if len(found) < 4 or found != sorted(found) or len(set(found)) < 4:
            return t
        return "\n".join(_TAIL.sub("", x) for x in lines)

    return text.map(one)


def without_head(text: Column, head: Column, least: int = 200) -> Column:
    """A long text without the running head at its start."""
    return F.when((F.length(text) >= least) & text.startswith(head) & (head != ""), F.ltrim(F.substr(text, F.length(head) + 1))).otherwise(text)


def identifier_key(c: Column) -> Column:
    """struct that orders "21", "21A", "21B", "371-I" as they are numbered."""
    return F.struct(F.regexp_extract(c, r"^(\d+)", 1).cast("int").alias("n"), F.length(F.regexp_extract(c, r"([A-Z]*)$", 1)).alias("l"), F.regexp_extract(c, r"([A-Z]*)$", 1).alias("s"))


def styled(text: Column, runs: Column) -> Column:
    """array<struct<style, text>>: a text cut at its style runs (start, end, style)."""
    return F.transform(runs, lambda r: F.struct(r["style"].alias("style"), F.substr(text, r["start"] + 1, r["end"] - r["start"]).alias("text")))


def escaped(text: Column) -> Column:
    """Text safe inside HTML."""
    out = text
    for a, b in ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def increasing(df: DataFrame, group: list[str], order: str, keys: list[str]) -> DataFrame:
    """Rows whose keys are not greater than those of the row before."""
    now = F.struct(*keys)
    return df.withColumn("__p", F.lag(now).over(Window.partitionBy(*group).orderBy(order))).where(F.col("__p").isNotNull() & (now <= F.col("__p"))).drop("__p")

"""Filtered, sorted, paged browsing with exact totals and facets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTS = {
    "recent": [("decision_date", "desc"), ("id", "asc")],
    "oldest": [("decision_date", "asc"), ("id", "asc")],
    "title": [("title", "asc"), ("id", "asc")],
}


@dataclass(frozen=True)
class Filters:
    """What a browse request asks for; empty fields ask for nothing."""

    ids: list[str] = field(default_factory=list)
    party: str = ""
    reporter: str = ""
    neutral_citation: str = ""
    year_from: int | None = None
    year_to: int | None = None
    date_from: str = ""
    date_to: str = ""
    judges: list[str] = field(default_factory=list)
    disposal: list[str] = field(default_factory=list)
    era: list[str] = field(default_factory=list)
    court: list[str] = field(default_factory=list)
    bench: list[int] = field(default_factory=list)
    bench_min: int | None = None
    bench_max: int | None = None
    language: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        bounded(self.year_from, 1800, 2200), bounded(self.year_to, 1800, 2200)
        bounded(self.bench_min, 1, 50), bounded(self.bench_max, 1, 50)
        for a, b in (self.year_from, self.year_to), (self.bench_min, self.bench_max):
            if a is not None and b is not None and a > b:
                raise ValueError("a range ends before it begins")


def bounded(value: int | None, least: int, most: int) -> int | None:
    """``value`` if it is null or a whole number of least..most, else an error."""
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most):
        raise ValueError(f"{value!r} is not a whole number from {least} to {most}")
    return value


def iso_date(text: Column) -> Column:
    """The text if it is a real date written YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def iso_text(text: str) -> str | None:
    """The bound if it is a real date written YYYY-MM-DD; any other bound asks for nothing."""
    try:
        return text if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) and date.fromisoformat(text) else None
    except ValueError:
        return None


def listed(values: list, most: int) -> list:
    """Trimmed, without repeats and empties, at most ``most`` (the request's own limit)."""
    clean = [v.strip() if isinstance(v, str) else v for v in values]
    return list(dict.fromkeys(v for v in clean if v not in ("", None)))[:most]


def like_folded(c: Column, part: str, prefix: bool = False) -> Column:
    """Case-insensitive contains or prefix, with no signs of special meaning."""
    low = F.lower(c)
    return low.startswith(part.lower()) if prefix else F.contains(low, F.lit(part.lower()))


def csv_holds(c: Column, codes: list[str]) -> Column:
    """A comma-separated field holds one of the codes, blanks and case apart."""
    return F.arrays_overlap(F.split(F.upper(F.replace(c, F.lit(" "), F.lit(""))), ","), F.array(*[F.lit(x.strip().upper()) for x in codes]))


def browse_filter(judgments: DataFrame, f: Filters, bridge: DataFrame | None = None, judges: DataFrame | None = None) -> DataFrame:
    """The judgments that meet every filter; null fields meet none that is asked for."""
    out = judgments
    for name, most in ("disposal", 40), ("era", 10), ("court", 10):
        if values := listed(getattr(f, name), most):
            out = out.where(F.col({"disposal": "disposal_nature"}.get(name, name)).isin(values))
    if values := listed(f.ids, 50):
        out = out.where(F.col("id").isin(values))
    if values := listed(f.bench, 50):
        out = out.where(F.col("bench_size").isin(values))
    if f.party.strip():
        out = out.where(like_folded(F.col("petitioner"), f.party.strip()) | like_folded(F.col("respondent"), f.party.strip()))
    if f.reporter.strip():
        out = out.where(like_folded(F.col("citation"), f.reporter.strip()))
    if f.neutral_citation.strip():
        out = out.where(like_folded(F.col("neutral_citation"), f.neutral_citation.strip(), prefix=True))
    dated = iso_date(F.col("decision_date"))
    for c, low, high in (F.col("decision_year"), f.year_from, f.year_to), (F.col("bench_size"), f.bench_min, f.bench_max), (dated, iso_text(f.date_from), iso_text(f.date_to)):
        if low is not None:
            out = out.where(c >= low)
        if high is not None:
            out = out.where(c <= high)
    if values := listed(f.language, 20):
        out = out.where(csv_holds(F.col("available_languages"), values))
    if values := listed(f.judges, 20):
        named = bridge.join(F.broadcast(judges.where(F.col("name").isin(values))), F.col("judge_id") == judges.id, "left_semi")  # at most 20 names
        out = out.join(named.withColumnRenamed("judgment_id", "id"), "id", "left_semi")
    return out


def page(df: DataFrame, sort: str, number: int = 1, size: int = 20, deepest: int = 50_000) -> DataFrame:
    """One page of a total order, nulls last both ways, as are dates not written YYYY-MM-DD; pages beyond ``deepest`` rows are empty."""
    bounded(number, 1, 10_000), bounded(size, 1, 100)
    first = (number - 1) * size
    if first >= deepest:
        return df.limit(0)
    key = lambda c: iso_date(F.col(c)) if c == "decision_date" else F.col(c)
    order = [key(c).desc_nulls_last() if way == "desc" else key(c).asc_nulls_last() for c, way in SORTS[sort]]
    return df.orderBy(*order).offset(first).limit(size)


def facets(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(facet, value, n): the commonest values of several columns in one pass, ties by value; nulls are no values."""
    rows = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in limits])
    n = df.select(F.explode(rows).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    r = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return n.withColumn("r", r).where(F.col("r") <= most[F.col("facet")]).drop("r")


def with_selected(buckets: DataFrame, selected: list[str]) -> DataFrame:
    """(value, n): the buckets, and each selected value that has none with 0."""
    spark = buckets.sparkSession
    want = spark.createDataFrame([(v,) for v in listed(selected, 1000)], "value string")
    return buckets.select("value", "n").join(want, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def seated(bridge: DataFrame, judges: DataFrame) -> DataFrame:
    """(judgment_id, judges array<string>): names in order of seat; rows of one seat and judge count once."""
    named = bridge.distinct().join(judges.select(F.col("id").alias("judge_id"), "name"), "judge_id")
    return named.groupBy("judgment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seat", "name"))), lambda x: x["name"]).alias("judges"))

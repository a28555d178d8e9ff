"""Metadata from several sources: warnings, status, reconciliation, overlays; and the report of an evaluation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters with marks and their bare letters, by rule: the Latin letters up to U+024F that decompose into one.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
_BARE = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]
# Warnings with which a record is not verified.
BLOCKING = ["missing_coram", "missing_bench_size", "bench_coram_count_mismatch", "author_not_in_coram"]


def folded(c: Column) -> Column:
    """Lower case without marks on Latin letters: the key for sorting and contains."""
    return F.lower(F.translate(c, "".join(_MARKED), "".join(_BARE)))


def metadata_warnings(judges: Column, authors: Column, bench_size: Column, case_number: Column) -> Column:
    """array<string> of what is missing or does not agree."""
    none = F.coalesce(F.size(judges) < 1, F.lit(True))
    return F.array_compact(
        F.array(
            F.when(none, "missing_coram"),
            F.when(bench_size.isNull(), "missing_bench_size").when(~none & (bench_size != F.size(judges)), "bench_coram_count_mismatch"),
            F.when(F.coalesce(F.trim(case_number), F.lit("")) == "", "missing_case_number"),
            F.when(F.size(F.array_except(F.coalesce(authors, F.array().cast("array<string>")), F.coalesce(judges, F.array().cast("array<string>")))) > 0, "author_not_in_coram"),
        )
    )


def metadata_status(warnings: Column) -> Column:
    return F.when(F.arrays_overlap(warnings, F.array(*map(F.lit, BLOCKING))), "needs_review").otherwise("verified")


def equivalent_names(a: str, b: str) -> bool:
    """Names that differ in case, marks, dots and initials only: the same surname, and each given name or its initial in order."""

    def parts(x: str) -> list[str]:
        x = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
        return [w for w in "".join(c if c.isalnum() else " " for c in x).split() if w]

    p, q = parts(a), parts(b)
    if not p or not q or p[-1] != q[-1]:
        return "".join(p) == "".join(q) and bool(p)
    p, q = p[:-1], q[:-1]
    return len(p) == len(q) and all(x == y or (len(x) == 1 or len(y) == 1) and x[0] == y[0] for x, y in zip(p, q))


def same_bench(first: Column, second: Column) -> Column:
    """Every name of one list has its own equivalent in the other, and none is left."""

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(a, b) -> bool:
            rest = list(b if b is not None else [])
            for n in a if a is not None else []:
                hit = next((i for i, m in enumerate(rest) if equivalent_names(n, m)), None)
                if hit is None:
                    return False
                rest.pop(hit)
            return not rest

        return pd.Series([one(a, b) for a, b in zip(x, y)], dtype="boolean")

    return same(first, second)


def reconciled(upstream: DataFrame, opening: DataFrame, key: str) -> DataFrame:
    """(key, judges, authors, case_number, warnings): upstream values, with the opening page's names and order where both name the same bench.

    Columns of both: judges, authors (array<string>), case_number. A bench that differs keeps the upstream one with a warning.
    """
    o = opening.select(key, *[F.col(c).alias(f"o_{c}") for c in ("judges", "authors", "case_number")])
    both = upstream.join(o, key, "left")
    named = F.coalesce(F.size("o_judges") > 0, F.lit(False))
    same = named & same_bench(F.col("judges"), F.col("o_judges"))
    disagree = same & (F.size("authors") > 0) & (F.size("o_authors") > 0) & ~same_bench(F.col("authors"), F.col("o_authors"))
    return both.select(
        key,
        F.when(same, F.col("o_judges")).otherwise(F.col("judges")).alias("judges"),
        F.when(same, F.col("o_authors")).otherwise(F.col("authors")).alias("authors"),
        F.coalesce("o_case_number", "case_number").alias("case_number"),
        F.array_compact(F.array(F.when(named & ~same, "ocr_coram_mismatch"), F.when(disagree, "upstream_author_marker_disagrees_with_pdf"))).alias("warnings"),
    )


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with the columns of ``over`` laid on them: a row of ``over`` replaces values, nulls too; base rows without one stay."""
    cols = [c for c in over.columns if c != key]
    o = over.select(key, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__has"))
    both = base.join(o, key, "left")
    own = [F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns]
    return both.select(*own, *[F.col(f"__{c}").alias(c) for c in cols if c not in base.columns])


def last_at_first_place(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, with the values of its last row and the place of its first (column ``place``)."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in rest], F.min(order).alias("place"))


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], created: str) -> DataFrame:
    """All new rows, with ``created`` of the old row of their key where there is one, and the old rows without a new one."""
    was = old.select(*keys, F.col(created).alias("__c"))
    fresh = new.join(was, keys, "left").select(*[F.coalesce("__c", created).alias(created) if c == created else F.col(c) for c in new.columns])
    return old.join(new.select(*keys), keys, "left_anti").unionByName(fresh)


def timeline(df: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Column ``place`` from 1: by key in each group, those without one last, equal ones as they came."""
    bare = F.coalesce(F.trim(key), F.lit("")) == ""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(bare, F.when(~bare, F.col(key)), order)))


@F.pandas_udf(StringType())
def vector_literal(v: pd.Series) -> pd.Series:
    """A vector as text: eight significant digits, in brackets, without blanks."""
    return v.map(lambda x: None if x is None else "[" + ",".join(f"{float(n):.8g}" for n in x) + "]")


def evaluation(cases: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of metrics, one row per reviewed case) of a retrieval evaluation.

    ``cases``: id, review_status, category, must_qualify, required, acceptable, relevant (array<string>). ``runs``:
    case_id, predicted, retrieved (array<string>), citations, authorities (array<string> of verdicts), temporal,
    insufficient, transition (pass, fail or null). Only cases with status ``lawyer_reviewed`` count; one without a run
    is ``missing_run``. Every rate comes with its denominator and is null where nothing was counted.
    """
    from folioforge.operators.quality import exact_set, ratio, recall_at

    c = cases.where("review_status = 'lawyer_reviewed'")
    x = c.join(runs.withColumn("has", F.lit(True)), c["id"] == runs["case_id"], "left")
    has = F.coalesce("has", F.lit(False))
    n = lambda col, *values: F.coalesce(F.size(F.filter(col, lambda v: v.isin(*values))), F.lit(0))
    passed = lambda col: F.when(F.col(col).isin("pass", "fail"), F.col(col) == "pass")
    per = x.select(
        F.col("id").alias("case_id"),
        F.when(has, "scored").otherwise("missing_run").alias("status"),
        F.when(has, exact_set(F.coalesce("predicted", F.array().cast("array<string>")), F.col("required"), F.coalesce("acceptable", F.array().cast("array<string>")))).alias("correct_section"),
        F.when(has, recall_at(F.coalesce("retrieved", F.array().cast("array<string>")), F.col("relevant"), 20)).alias("recall_at_20"),
        n("citations", "entailed", "partial").alias("relevant_citations"),
        n("citations", "entailed").alias("entailed_citations"),
        n("citations", "entailed", "partial", "irrelevant").alias("labelled_citations"),
        n("authorities", "hallucinated").alias("hallucinated"),
        n("authorities", "verified", "hallucinated").alias("labelled_authorities"),
        F.coalesce(F.size("authorities") > 0, F.lit(False)).alias("has_authorities"),
        passed("temporal").alias("temporal"),
        F.when(F.col("must_qualify"), passed("insufficient")).alias("insufficient"),
        F.when(F.col("category") == "code_transition", passed("transition")).alias("transition"),
    )
    share = lambda col: [F.count_if(F.col(col)).alias(f"{col}_n"), F.count(col).alias(f"{col}_of")]
    t = per.agg(
        F.count("*").alias("reviewed"),
        F.count_if(F.col("status") == "scored").alias("scored"),
        *[e for col in ("correct_section", "temporal", "insufficient", "transition") for e in share(col)],
        F.round(F.avg("recall_at_20"), 4).alias("recall_at_20"),
        F.count("recall_at_20").alias("recall_at_20_of"),
        *[F.coalesce(F.sum(col), F.lit(0)).alias(col) for col in ("relevant_citations", "entailed_citations", "labelled_citations", "hallucinated", "labelled_authorities")],
        F.count_if("has_authorities").alias("answers_with_authorities"),
        F.count_if(F.col("hallucinated") > 0).alias("answers_with_hallucination"),
    )
    rates = [ratio(F.col(f"{c}_n"), F.col(f"{c}_of")).alias(c) for c in ("correct_section", "temporal", "insufficient", "transition")]
    rates += [ratio(F.col("relevant_citations"), F.col("labelled_citations")).alias("citation_precision"), ratio(F.col("entailed_citations"), F.col("labelled_citations")).alias("citation_entailment")]
    rates += [ratio(F.col("hallucinated"), F.col("labelled_authorities")).alias("hallucinated_rate"), ratio(F.col("answers_with_hallucination"), F.col("answers_with_authorities")).alias("answers_hallucinated_rate")]
    return t.select("*", (F.col("reviewed") - F.col("scored")).alias("missing_runs"), *rates), per

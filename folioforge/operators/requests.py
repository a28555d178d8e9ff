"""What a request asks for: direct references, retrieval policy, rewriting, paging, spans to show."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import contains_folded
from folioforge.operators.search import has_phrase, matched_terms
from folioforge.operators.sequence import first_rows


def direct_numbers(query: str, unit: str) -> list[str]:
    """Numbers of units that a query names ("clauses 3, 5 and 7"), in order, without repeats, eight at most (the feature's limit)."""
    found = []
    for m in re.finditer(rf"\b{unit}s?\s+(\d{{1,3}}(?:\s*(?:,|and|&)\s*\d{{1,3}})*)", query, re.I):
        found += re.findall(r"\d{1,3}", m[1])
    return list(dict.fromkeys(found))[:8]


def candidate_limit(limit: int) -> int:
    """How many candidates each list gives for a page of ``limit``."""
    return min(max(limit * 5, 40), 100)


def direct_first(direct: DataFrame, ranked: DataFrame, id_col: str, order: list[Column], limit: int) -> DataFrame:
    """(id, score, direct): the units named by the request in their order, then the ranked ones that are not among them; ``limit`` in all."""
    a = direct.select(id_col, F.lit(1.0).alias("score"), F.lit(True).alias("direct"), F.row_number().over(Window.orderBy(*order)).alias("r"))  # what is named is bounded by the request
    b = ranked.join(F.broadcast(a.select(id_col)), id_col, "left_anti").select(id_col, "score", F.lit(False).alias("direct"), F.col("rank").alias("r"))
    return a.unionByName(b).orderBy(F.desc("direct"), "r").limit(limit).select(id_col, "score", "direct")


def retrieve(search: Callable[[str, tuple | None], DataFrame], query: str, original: str, years: tuple | None, group: str, id_col: str, limit: int, cap: int, widen: bool = True, least: int = 5) -> tuple[DataFrame, bool]:
    """(hits, widened): without the years where they leave nothing; with those of the original query behind where there are
    fewer than ``least``; at most ``cap`` of a group and ``limit`` in all. ``search`` gives (id, group, score, rank)."""
    hits, widened = search(query, years), False
    if widen and years and hits.isEmpty():
        hits, widened = search(query, None), True
    if original != query and hits.limit(least).count() < least:
        more = search(original, None if widened else years).join(hits.select(id_col), id_col, "left_anti")
        hits = hits.withColumn("__l", F.lit(0)).unionByName(more.withColumn("__l", F.lit(1)))
    else:
        hits = hits.withColumn("__l", F.lit(0))
    kept = first_rows(hits, [group], [F.col("__l"), F.col("rank")], cap)
    return kept.orderBy("__l", "rank").limit(limit).drop("__l"), widened


def rewrite(query: str, spelling: list[tuple[str, str]], acronyms: list[tuple[str, str, str]], longest: int = 500) -> dict:
    """A query with its spelling corrected by rule, what was corrected, the acronyms it holds with their expansions, the case it names, and the enriched query.

    ``spelling``: (pattern, replacement); ``acronyms``: (pattern, acronym, expansion).
    """
    fixed, corrections = query, []
    for pattern, right in spelling:
        if m := re.search(rf"\b{pattern}\b", fixed, re.I):
            corrections.append((m[0], right))
            fixed = re.sub(rf"\b{pattern}\b", right, fixed, flags=re.I)
    known = [(a, e) for pattern, a, e in acronyms if re.search(rf"\b{pattern}(?!\w)", fixed, re.I)]
    case = None
    if re.search(r"\s(?:v\.?|vs\.?|versus)\s", f" {query} ", re.I):
        case = re.sub(r"^(?:find|show|search for|tell me about|what (?:was|is) (?:held|decided) in|give me)\s+", "", query, flags=re.I).strip()[:240] or None
    enriched = " ".join([fixed, *dict.fromkeys(e for _, e in known)])[:longest].strip()
    return {"corrected": fixed, "corrections": corrections, "acronyms": known, "case_name": case, "enriched": enriched}


def clamped_page(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """One page of a list, its number moved into 1..last."""
    last = max(1, -(-df.count() // size))
    number = min(max(number, 1), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def spans(text: Column, part: str) -> Column:
    """array<int>: where ``part`` stands in the text, case apart, without overlaps; from 0."""
    pieces = F.split(F.lower(text), re.escape(part.lower()), -1)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc.at + n + len(part)).alias("at"), F.concat(acc.out, F.array(acc.at + n)).alias("out"))
    return F.aggregate(sizes, start, step, lambda a: a.out)


def boosted(query_terms: list[str], fields: dict[str, tuple[float, float]], body: str) -> Column:
    """Sum of the boosts of the clauses that hold: each field's phrase and all-terms boosts (the best field counts), the body's phrase 8, near 4, all terms 1.5."""
    phrase = F.greatest(*[F.when(has_phrase(F.coalesce(f, F.lit("")), query_terms), p).otherwise(0.0) for f, (p, _) in fields.items()])
    every = F.greatest(*[F.when(matched_terms(F.coalesce(f, F.lit("")), query_terms) == len(query_terms), a).otherwise(0.0) for f, (_, a) in fields.items()])
    text = F.coalesce(body, F.lit(""))
    own = [F.when(has_phrase(text, query_terms), 8.0).otherwise(0.0), F.when(has_phrase(text, query_terms, 2), 4.0).otherwise(0.0), F.when(matched_terms(text, query_terms) == len(query_terms), 1.5).otherwise(0.0)]
    return phrase + every + reduce(lambda a, b: a + b, own)


def holds_any(columns: list[str], part: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(contains_folded(F.col(c), part), F.lit(False)) for c in columns])

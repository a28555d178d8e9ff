"""From page text to numbered paragraphs, merged parts, classified blocks and parsed citations."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERED = re.compile(r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})[.)])\s+(\S.*)$")
PARAGRAPH = T.ArrayType(T.StructType([T.StructField("number", T.StringType()), T.StructField("text", T.StringType())]))


def split_paragraphs(text: str) -> list[tuple[str | None, str]]:
    """(number, text) of each paragraph: a blank line or a line beginning "[n]", "n." or "n)" opens one.

    A line ending in a hyphen is joined to a next one that begins in lower case.
    """
    out: list[tuple[str | None, list[str]]] = []
    open_ = False
    for line in text.splitlines():
        s = " ".join(line.split())
        if not s:
            open_ = False
            continue
        m = _NUMBERED.match(s)
        if m:
            out.append((m[1] or m[2], [m[3]]))
        elif not open_:
            out.append((None, [s]))
        else:
            last = out[-1][1]
            if last[-1].endswith("-") and s[0].islower():
                last[-1] = last[-1][:-1] + s
            else:
                last.append(s)
        open_ = True
    return [(n, " ".join(x)) for n, x in out]


@F.pandas_udf(PARAGRAPH)
def paragraphs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else [{"number": n, "text": x} for n, x in split_paragraphs(t)])


def merge_two(a: str, b: str, least: int = 2) -> str:
    """``a`` and ``b`` as one text, without the longest run of at least ``least`` words that ends one and begins the other."""
    x, y = a.split(), b.split()
    for k in range(min(len(x), len(y)), least - 1, -1):
        if x[-k:] == y[:k]:
            return " ".join(x + y[k:])
    return f"{a} {b}"


def merged_parts(df: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """(group..., parts, text): the parts of each group in order, overlaps taken out; null texts are passed over.

    A group is the parts of one paragraph, so it is small.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(order, F.lit(0)).alias("o"), F.col(text).alias("t"))))
    g = df.where(F.col(text).isNotNull()).groupBy(*group).agg(F.transform(rows, lambda r: r.t).alias("parts"))

    @F.pandas_udf("string")
    def fold(parts: pd.Series) -> pd.Series:
        def one(p) -> str:
            out = p[0]
            for t in p[1:]:
                out = merge_two(out, t)
            return out

        return parts.map(one)

    return g.select(*group, F.size("parts").alias("parts"), fold("parts").alias("text"))


def block_kind(text: Column) -> Column:
    """footnote, heading or paragraph, by its first signs and its share of capitals."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.length(letters)
    note = text.rlike(r"^\s*(?:\*+|†|‡|\d{1,2}\s*\.\s*(?:See|Ibid|Supra))")
    head = (F.length(text) <= 120) & (F.length(letters) > 0) & (capitals >= 0.78)
    return F.when(note, "footnote").when(head, "heading").otherwise("paragraph")


# What a later decision does to an earlier one.
TREATMENTS = ["not followed", "referred to", "relied on", "followed", "distinguished", "overruled", "disapproved", "approved", "affirmed", "applied", "explained", "considered", "cited"]


def citation_row(line: Column) -> Column:
    """struct(citation, treatment, paragraphs): a row of a table of cited cases, or null; exactly one treatment must stand in it.

    A longer treatment is no case of the shorter one in it ("not followed").
    """
    ways = "|".join(t.replace(" ", r"\s+") for t in sorted(TREATMENTS, key=len, reverse=True))
    said = F.regexp_extract_all(F.lower(line), F.lit(rf"\b({ways})\b"), F.lit(1))
    cite = F.regexp_extract(line, r"(\[\d{4}\] (?:Supp\. )?\d+ [A-Z](?:\.?[A-Z])+\.? \d+|\(\d{4}\) \d+ [A-Z]+ \d+)", 1)
    paras = F.transform(F.regexp_extract_all(F.regexp_extract(line, r"(?i)paras?\.? ([\d(), and-]+)", 1), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    row = F.struct(cite.alias("citation"), F.regexp_replace(F.get(said, F.lit(0)), r"\s+", " ").alias("treatment"), paras.alias("paragraphs"))
    return F.when((F.size(said) == 1) & (cite != ""), row)


def judge_name(name: Column) -> Column:
    """A judge's name without titles, dots and outer signs."""
    bare = F.regexp_replace(name, r"(?i)\b(?:hon'?ble|mr|mrs|ms|dr|justice|the|chief|j\.?|c\.?j\.?i?|jj)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.*,]", " "), r"\s+", " "))


def judge_list(names: Column) -> Column:
    """array<string>: comma- or "and"-separated names, in order, without repeats."""
    parts = F.split(names, r",|;|\band\b|&")
    return F.array_distinct(F.filter(F.transform(parts, judge_name), lambda n: n != ""))


def without_tags(markup: Column) -> Column:
    """Text of HTML: tags dropped, entities decoded, blanks collapsed."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(html.unescape(re.sub(r"(?is)<(script|style).*?</\1>|<[^>]*>", " ", t)).split()))

    return decode(markup)


def fnv1a(texts: list[str]) -> int:
    """32-bit FNV-1a over the UTF-16 units of the texts."""
    h = 0x811C9DC5
    for t in texts:
        for u in np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
            h = ((h ^ u) * 0x01000193) & 0xFFFFFFFF
    return h


def print_of(df: DataFrame, group: str, order: list[Column], text: str, version: str = "v1") -> DataFrame:
    """(group, print): "version:chunks:signs:hash" over the group's texts in order; a group is one document."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(text, F.lit("")).alias("t"))))

    @F.pandas_udf("string")
    def mark(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: f"{version}:{len(p)}:{sum(map(len, p))}:{fnv1a(list(p)):08x}")

    return df.groupBy(group).agg(F.transform(rows, lambda r: r.t).alias("p")).select(group, mark("p").alias("print"))


def align(a: list[str], b: list[str], match: int = 3, miss: int = -3, gap: int = -1) -> list[tuple[int, int]]:
    """Smith-Waterman local alignment of two word lists: pairs of equal words' places on the best path."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    code = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    y = np.array([code[w] for w in b])
    h = np.zeros((n + 1, m + 1), np.int32)
    steps = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        s = np.where(y == code[a[i - 1]], match, miss)
        best = np.maximum(np.maximum(h[i - 1, :-1] + s, h[i - 1, 1:] + gap), 0)
        # gaps along the row: the running maximum of the scores before, less their distance
        row = np.concatenate([[0], best]) - steps
        h[i] = np.maximum(np.maximum.accumulate(row) + steps, 0)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    out: list[tuple[int, int]] = []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (match if same else miss):
            if same:
                out.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def alignment_share(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that the best local alignment finds in ``b``; null for null or no words."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None or not s.split():
                return None
            u = s.lower().split()
            return len(align(u, t.lower().split())) / len(u)

        return pd.Series([one(s, t) for s, t in zip(x, y)], dtype="float64")

    return share(a, b)


def in_sequence(df: DataFrame, group: str, order: list[str], number: str) -> DataFrame:
    """Column ``paragraph``: rows belong to the last number that was the one expected next; before the first it is 0.

    Numbers out of turn (quotations, lists) open nothing. One group is one document.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("paragraph", T.IntegerType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        at, out = 0, []
        for n in t.column(number).to_pylist():
            if n is not None and str(n).isdigit() and int(n) == at + 1:
                at += 1
            out.append(at)
        return t.append_column("paragraph", pa.array(out, pa.int32()))

    return df.groupBy(group).applyInArrow(run, schema)


def clustered_lines(df: DataFrame, page: list[str], top: str, tolerance: float) -> DataFrame:
    """Column ``line_no`` from 0: elements of a page, by height, join a line while within ``tolerance`` of its mean."""
    schema = T.StructType([*df.schema.fields, T.StructField("line_no", T.IntegerType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(top, "ascending")])
        no, total, n, out = -1, 0.0, 0, []
        for y in t.column(top).to_pylist():
            if n and abs(y - total / n) <= tolerance:
                total, n = total + y, n + 1
            else:
                no, total, n = no + 1, y, 1
            out.append(no)
        return t.append_column("line_no", pa.array(out, pa.int32()))

    return df.groupBy(*page).applyInArrow(run, schema)


def byte_batches(df: DataFrame, group: str, order: list[str], size: str, most: int) -> DataFrame:
    """Column ``batch_no`` from 0 within each group: a new batch begins where the next row would pass ``most`` bytes."""
    schema = T.StructType([*df.schema.fields, T.StructField("batch_no", T.IntegerType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        no, held, out = 0, 0, []
        for s in t.column(size).to_pylist():
            if held and held + (s or 0) > most:
                no, held = no + 1, 0
            held += s or 0
            out.append(no)
        return t.append_column("batch_no", pa.array(out, pa.int32()))

    return df.groupBy(group).applyInArrow(run, schema)


def first_match(text: Column, passage: Column, words: int = 8) -> Column:
    """Place (word number from 0) where any of the passage's first windows of ``words`` words begins in the text; null if none."""

    @F.pandas_udf("int")
    def find(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, p):
            if s is None or p is None:
                return None
            t, q = re.findall(r"\w+", s.lower()), re.findall(r"\w+", p.lower())
            at: dict[tuple[str, ...], int] = {}
            for i in range(len(t) - words, -1, -1):
                at[tuple(t[i : i + words])] = i
            hits = (at.get(tuple(q[j : j + words])) for j in range(min(33, len(q) - words + 1)))
            return next((h for h in hits if h is not None), None)

        return pd.Series([one(s, p) for s, p in zip(x, y)], dtype="Int32")

    return find(text, passage)


_CITED = re.compile(r"\[\[([^\[\]]+)\]\]")


def inline_sources(answer: Column) -> Column:
    """array<string>: ids cited as [[id]], in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)))


def answer_problem(answer: Column, known: Column) -> Column:
    """What is wrong with a grounded answer, or null: nothing cited, an unknown source, or headings only."""
    cited = inline_sources(answer)
    body = F.filter(F.split(answer, r"\n+"), lambda b: ~b.rlike(r"^\s*(?:#|$)"))
    claims = F.filter(body, lambda b: F.size(F.filter(F.split(b, r"\s+"), lambda w: w != "")) >= 4)
    return (
        F.when(F.size(claims) == 0, "no substantive claim")
        .when(F.size(cited) == 0, "nothing cited")
        .when(F.size(F.array_except(cited, known)) > 0, "unknown source")
        .when(F.exists(claims, lambda b: ~b.rlike(r"\[\[[^\[\]]+\]\]")), "uncited claim")
    )


def gate(query: Column, has_context: bool = False) -> Column:
    """Why a question is not searched, or null: too short, a greeting, or letters without sense."""
    w = F.filter(F.split(F.lower(F.trim(query)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    letters = F.regexp_replace(F.lower(query), "[^a-z]", "")
    vowels = F.length(F.regexp_replace(letters, "[^aeiou]", ""))
    senseless = (F.length(letters) >= 8) & (vowels / F.length(letters) < 0.18) & letters.rlike("[bcdfghjklmnpqrstvwxyz]{5}")
    greeting = F.forall(w, lambda x: x.isin("hello", "hi", "hey", "there", "thanks", "thank", "you", "good", "morning", "evening")) & (F.size(w) > 0)
    return F.when(senseless, "senseless").when(greeting, "greeting").when((F.size(w) < 2) & F.lit(not has_context), "too short")


def cached_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What must be computed: wanted rows of which the cache has none of the same keys (id, version, fingerprint)."""
    return wanted.join(cache.select(*keys), keys, "left_anti")


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held

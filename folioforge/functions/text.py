"""Words, folding and scores of strings, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

# Words that carry no weight in a question, and in a title.
QUESTION_STOPS = (
    "about against act and are case cases court find for from give india indian law latest legal most of on recent show supreme the under what when where which with"
).split()
TITLE_STOPS = "and case in india ors others state the union v vs versus".split()


def words(text: Column) -> Column:
    """array<string>: lower-case runs of letters and digits, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_words(query: str, most: int = 24) -> list[str]:
    """The words of a query as ``words`` cuts them, without repeats, at most ``most`` of them (the feature's limit)."""
    import re
    import unicodedata

    found = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", query).lower())
    if not found:
        raise ValueError("the query has no words")
    return list(dict.fromkeys(found[:most]))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unhyphen(text: Column) -> Column:
    """Without soft hyphens and with single blanks."""
    return collapse_spaces(F.regexp_replace(text, "­", ""))


def excerpt(text: Column, most: int, ellipsis: str = "…") -> Column:
    """At most ``most`` signs, cut text ending in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - len(ellipsis))), F.lit(ellipsis))).otherwise(text)


def contains_folded(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def title_words(text: Column) -> Column:
    """Different words of at least two signs that carry weight in a title, in order."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOPS)))


def title_score(query: str, title: Column, citation: Column | None = None) -> Column:
    """Share of the query's words in title and citation; +0.5 if the title's own words equal the query's, else +0.2 if one holds the other.

    Words of one sign and title stop words do not count; an empty title is held by any query, and a query without words scores 0.
    """
    q = [w for w in query_words(query, 1000) if len(w) > 1 and w not in TITLE_STOPS]
    if not q:
        return F.lit(0.0)
    own = title_words(F.coalesce(title, F.lit("")))
    both = own if citation is None else title_words(F.concat_ws(" ", title, citation))
    held = F.size(F.array_intersect(both, F.array(*map(F.lit, q)))) / F.lit(float(len(q)))
    tq, tt = " ".join(q), F.array_join(own, " ")
    bonus = F.when(tt == tq, 0.5).when(F.contains(tt, F.lit(tq)) | F.contains(F.lit(tq), tt), 0.2).otherwise(0.0)
    return held + bonus


def question_terms(query: str, most: int = 16) -> list[str]:
    """Different words of a question of more than two signs that carry weight, at most ``most`` (the feature's limit)."""
    return [w for w in query_words(query, 1000) if len(w) > 2 and w not in QUESTION_STOPS][:most]


def passage_score(text: Column, terms: list[str]) -> Column:
    """100 for each term held, up to 60 for length, and 180 off a passage of under 120 signs."""
    held = sum((F.when(F.contains(F.lower(text), F.lit(t)), 100).otherwise(0) for t in terms), F.lit(0))
    size = F.least(F.length(F.trim(text)), F.lit(2400))
    return held + size / 40 - F.when(size < 120, 180).otherwise(0)


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of ``size`` words, each sharing ``overlap`` with the one before; short texts stay as they are."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    step = size - overlap
    last = F.ceil((F.size(w) - overlap) / step).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
    return F.when(F.size(w) <= size, F.array(text)).otherwise(cut)


def searchable(text: Column) -> Column:
    """At least 20 signs and two words of two letters."""
    return (F.length(F.trim(text)) >= 20) & (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) >= 2)


# Signs that printed text is expected to hold beside letters and digits.
EXPECTED_SIGNS = ".,;:!?'-()[]/\"%&§₹–—"


def quality_counts(text: Column) -> dict[str, Column]:
    """Counts a text's quality is made of, all but that of common words."""
    signs = "".join("\\" + c if c in "-[]" else c for c in EXPECTED_SIGNS)
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"[A-Za-z][0-9!|;{}~][A-Za-z]|[A-Za-z][.!?,;:][A-Za-z]"))
    return {
        "n_chars": F.length(text),
        "n_words": F.regexp_count(text, F.lit("[A-Za-z]{3,}")),
        "n_tokens": F.regexp_count(text, F.lit(r"\S+")),
        "n_suspicious": F.size(tokens),
        "n_signs": F.length(F.regexp_replace(text, r"\s", "")),
        "n_alpha": F.length(F.regexp_replace(text, r"[^\p{L}]", "")),
        "n_odd": F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}\s{signs}]", "")),
    }


def quality_score(n_common: Column, n_words: Column, n_alpha: Column, n_signs: Column, n_suspicious: Column, n_tokens: Column, n_odd: Column) -> Column:
    """0..1: common words and letters, less suspicious tokens and odd signs; a rate of nothing is 0."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = 0.65 * rate(n_common, n_words) + 0.35 * F.least(rate(n_alpha, n_signs) / 0.95, F.lit(1.0))
    x = x - F.least(rate(n_suspicious, n_tokens) * 2, F.lit(0.1)) - F.least(rate(n_odd, n_signs) * 5, F.lit(0.1))
    return F.round(F.greatest(F.lit(0.0), F.least(x, F.lit(1.0))), 6)

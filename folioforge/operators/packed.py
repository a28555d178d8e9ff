"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that divide, words for "and", and ways to write that there is nothing.
DIVIDERS = ",;|/\n\r\t，、；｜／·•&＆"
AND_WORDS = ["and", "et", "und", "y", "और"]
NOTHING = ["-", "--", "—", "–", ".", "?", "n/a", "na", "n.a.", "nil", "none", "null", "nan", "not available", "not known", "unknown", "tbd"]

# Private-use signs that stand for a kept span; where a text has them itself, they are kept as spans too.
_QUOTED, _ROUND, _END = "\ue000", "\ue002", "\ue001"
_SPAN = (
    r'"(?:[^"]|"")*"'
    r"|“[^”]*”|‘[^’]*’"
    r"|(?<![\p{L}\p{N}])'(?:[^']|''|(?<=\p{L})'(?=\p{L}))*'(?![\p{L}\p{N}])"
    r"|\((?:[^()]|\([^()]*\))*\)"
    r"|[\ue000-\ue002]"
)
_SLOT = r"[\ue000\ue002](\d+)\ue001"
_BLANKS = r"[\s\u00a0]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANKS}+|{_BLANKS}+$", "")


def _weave(gaps: Column, fill: Column) -> Column:
    """gaps[0] fill[0] gaps[1] fill[1] ... gaps[n]"""
    return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(fill, i), F.lit(""))))), "")


def _unquoted(cell: Column, spans: Column) -> Column:
    """A cell with its spans put back; a cell that is one quoted span loses its quotes."""
    kept = F.transform(F.regexp_extract_all(cell, F.lit(_SLOT), F.lit(1)), lambda i: F.get(spans, i.cast("int")))
    v = _trim(_weave(F.split(cell, _SLOT, -1), kept))
    return F.struct(v.alias("v"), _trim(cell).rlike(rf"^{_QUOTED}\d+{_END}$").alias("alone"))


def _bare(z: Column) -> Column:
    inner = _trim(F.substr(z.v, F.lit(2), F.length(z.v) - 2))
    doubled = lambda q: F.replace(inner, F.lit(q + q), F.lit(q))
    return F.when(~z.alone, z.v).when(z.v.startswith('"'), doubled('"')).when(z.v.startswith("'"), doubled("'")).otherwise(inner)


def split_packed(df: DataFrame, field: str, keep: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value of ``field``, with the columns ``keep`` and the position from 1.

    Quoted and round-bracketed spans are replaced by numbered slots, the rest
    is divided, and the spans are put back by array lookup. Blank space
    divides only a field in which nothing else does, and never before a round
    bracket. A quote or bracket that is never closed is an ordinary sign.
    Rows whose field is null, empty or a placeholder give no row. Repeated
    values stay, and so do repeated rows.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    text = _trim(F.coalesce(F.col(field).cast("string"), F.lit("")))
    for a, b in (r"\[", r"\]"), (r"\{", r"\}"):
        text = F.regexp_replace(text, rf"(?s)^{a}([^{a}{b}]*){b}$", "$1")
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], _trim(text).alias("t"))
    rows = rows.where((F.col("t") != "") & ~F.lower("t").isin(NOTHING))  # before a sign in a placeholder divides
    rows = rows.withColumn("spans", F.regexp_extract_all("t", F.lit(_SPAN), F.lit(0)))
    slots = F.transform("spans", lambda s, i: F.concat(F.when(s.startswith("("), _ROUND).otherwise(_QUOTED), i.cast("string"), F.lit(_END)))
    rows = rows.withColumn("masked", _weave(F.split("t", _SPAN, -1), slots))
    divide = rf"[{DIVIDERS}]|(?i)(?<![^\s{_END}])(?:{'|'.join(AND_WORDS)})(?![^\s{_QUOTED}])"
    cells = F.when(F.col("masked").rlike(divide), F.split("masked", divide, -1)).otherwise(F.split("masked", rf"{_BLANKS}+(?!{_ROUND})", -1))
    rows = rows.withColumn("cells", cells)
    rows = rows.withColumn("cells", F.transform("cells", lambda c: _unquoted(c, F.col("spans"))))
    values = F.filter(F.transform("cells", _bare), lambda v: (v != "") & ~F.lower(v).isin(NOTHING))
    out = rows.select(*names, F.posexplode(values).alias("__pos", "__value"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], (F.col("__pos") + 1).alias(pos), F.col("__value").alias(value))

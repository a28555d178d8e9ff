"""Splitting oversized items at natural boundaries, by content-defined landmarks.

A rolling hash over eight words marks landmarks; a piece is cut at the
landmark of least hash among the allowed places, moved to the nearest natural
boundary there: the end of a sentence or paragraph, where there is none that of
a clause, where there is none a comma. As the landmarks depend on the words around them
only, an edit alters the pieces near it and no others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import spread

_WORD = re.compile(r"\S+")
_SHORT = re.compile(r"(?:[^\W\d_]\.)+|(?:v|vs|Rs|No|Nos|Dr|Mr|Mrs|Ms|St|Co|Ltd|Art|Arts|Sec|Ss|cl|p|pp|para|Hon|viz|ie|eg|etc|Messrs|Smt|Shri|Jr|Sr|M)\.", re.I)
_CLOSERS = "\"'”’)]»"
WINDOW = 8


def pauses(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each word, how strongly the text pauses after it: 4 paragraph, 3 sentence, 2 clause, 1 comma, 0 none."""
    rank = np.zeros(len(spans), np.int8)
    for i in range(len(spans) - 1):
        word = text[spans[i][0] : spans[i][1]]
        gap = text[spans[i][1] : spans[i + 1][0]]
        if gap.count("\n") > 1:
            rank[i] = 4
            continue
        bare = word.rstrip(_CLOSERS)
        end = bare[-1:]
        if end in ".?!…":
            nxt = text[spans[i + 1][0]]
            if not (nxt.islower() or end == "." and _SHORT.fullmatch(bare.lstrip("([\"'“‘"))):
                rank[i] = 3
        elif end in ";:" or word in ("—", "–", "-"):
            rank[i] = 2
        elif end == ",":
            rank[i] = 1
    return rank


def _landmarks(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rolling hash of the WINDOW words that end at each word."""
    c = np.array([crc32(text[a:b].encode("utf-8", "surrogatepass")) for a, b in spans], dtype=np.uint64)
    h = np.zeros(len(c), np.uint64)
    base = np.uint64(1)
    for j in range(min(WINDOW, len(c))):
        h[j:] += c[: len(c) - j] * base
        base = base * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _snap(rank: np.ndarray, lo: int, hi: int, at: int) -> int:
    """The natural boundary in lo..hi (words before the cut) nearest to ``at``: an end of a sentence or paragraph, else of a clause, else a comma, else ``at`` itself."""
    r = np.minimum(rank[lo - 1 : hi], 3)
    places = np.nonzero(r == r.max())[0] + lo
    return int(places[np.abs(places - at).argmin()])


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces of ``text`` as (first sign, end sign, words, words shared with the piece before)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n, 0)]
    with np.errstate(over="ignore"):
        marks = _landmarks(text, spans)
    rank = pauses(text, spans)
    least, slack = limit // 2, overlap // 4
    pieces, start, done = [], 0, 0
    while True:
        if n - start <= limit:
            pieces.append((spans[start][0], spans[n - 1][1], n - start, done - start))
            return pieces
        lo, hi = done + max(1, min(least, (limit - (done - start)) // 2)), start + limit
        cut = _snap(rank, lo, hi, lo + int(marks[lo - 1 : hi].argmin()))
        pieces.append((spans[start][0], spans[cut - 1][1], cut - start, done - start))
        back = max(start + 1, cut - overlap)
        start = _snap(rank, max(start + 1, back - slack), min(cut, back + slack), back) if overlap else cut
        done = cut


def pieces(df: DataFrame, text_col: str, keep: list[str], limit: int = 220, overlap: int = 30) -> DataFrame:
    """One row per piece of each row's text: ``keep``, piece (from 1), of_pieces, text, n_words, n_shared.

    A word is a longest run of signs that are not white space. A text of at
    most ``limit`` words is one piece, as it is; a null text gives no row, an
    empty one a piece of no words. A word is never divided, however long.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, of, out, words, shared = [], [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                cuts = cut_points(t, limit, overlap)
                for j, (a, e, n, s) in enumerate(cuts):
                    row.append(i), piece.append(j + 1), of.append(len(cuts)), out.append(t[a:e]), words.append(n), shared.append(s)
            take = pa.array(row, pa.int64())
            made = [pa.array(piece, pa.int32()), pa.array(of, pa.int32()), pa.array(out, pa.string()), pa.array(words, pa.int32()), pa.array(shared, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), *made], [*names, "piece", "of_pieces", "text", "n_words", "n_shared"])

    cut = rows.mapInArrow(split, f"{schema}, piece int, of_pieces int, text string, n_words int, n_shared int")
    return cut.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "piece", "of_pieces", "text", "n_words", "n_shared")


def oversized(text: Column, limit: int) -> Column:
    """A cheap test that no text of more than ``limit`` words fails."""
    return F.length(text) > 2 * limit


def search_chunks(df: DataFrame, limit: int = 220, overlap: int = 30) -> DataFrame:
    """Staged passages as pieces of at most ``limit`` words, numbered on within their paragraph.

    Result: id, judgment_id, pdf_page, paragraph_index, part_index (from the
    row's own, moved on by the pieces that earlier parts of the paragraph
    gained), piece, of_pieces, text, n_words, n_shared. Rows staged twice
    count once; a paragraph is what ids of one prefix before ``:part`` name.
    A null part_index counts as 1; a row without an id is a paragraph of its own; null texts give no row.
    """
    keep = ["id", "judgment_id", "pdf_page", "paragraph_index", "part_index"]
    para = F.coalesce(F.regexp_replace("id", r":part[^:]*$", ""), F.concat(F.lit("?"), F.xxhash64(*keep[1:], "text").cast("string")))
    rows = spread(df.select(*keep, "text")).withColumn("para", para).withColumn("__h", F.xxhash64("text"))
    rows = rows.repartition("para").dropDuplicates(["para", "id", "__h"])
    cut = pieces(rows, "text", [*keep, "para"], limit, overlap)
    own = F.coalesce("part_index", F.lit(1))
    before = Window.partitionBy("para").orderBy(own).rangeBetween(Window.unboundedPreceding, -1)
    gained = F.coalesce(F.sum(F.when(F.col("piece") == 1, F.col("of_pieces") - 1)).over(before), F.lit(0))
    return cut.withColumn("part_index", (own + gained + F.col("piece") - 1).cast("int")).drop("para")


def oversized_ids(df: DataFrame, id_col: str, text_col: str, limit: int = 220, overlap: int = 30) -> DataFrame:
    """(id): each id with a text that ``pieces`` divides."""
    long = spread(df.select(id_col, text_col)).where(oversized(F.col(text_col), limit)).where(F.col(id_col).isNotNull())
    return pieces(long, text_col, [id_col], limit, overlap).where("of_pieces > 1").select(F.col(id_col).alias("id")).distinct()

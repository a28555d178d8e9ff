"""Noise in text from scanned pages: finding it and repairing it.

Running heads and page numbers are learned from the edge lines of all texts and
removed (``furniture``). Word forms are counted over all texts, and SQL on the
counts decides which rare forms are misread: a form's anagram hash plus the
difference of a confusable pair must be the hash of a far more frequent form
(``misread_forms``). The same counts decide whether a word divided at a line
end is a compound (``divided_words``). One pass takes every text apart (page
furniture, divided words, running words) and sends its open questions, never
the text, to those answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut, spread

from .furniture import Heads, Remover, learn

# Pairs (printed, seen) that recognition of print is known to confuse.
CONFUSED = [
    ("e", "c"), ("c", "e"), ("t", "l"), ("l", "t"), ("a", "o"), ("o", "a"), ("o", "0"), ("n", "u"), ("u", "n"), ("s", "5"), ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("l", "|"), ("i", "|"),
    ("l", "I"), ("I", "l"), ("i", "l"), ("l", "i"), ("g", "q"), ("q", "g"), ("h", "b"), ("b", "h"), ("y", "v"), ("v", "y"), ("f", "t"), ("t", "f"),
    ("b", "6"), ("g", "9"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"), ("Z", "2"), ("E", "F"), ("F", "E"), ("R", "K"), ("C", "G"), ("G", "C"),
    ("M", "N"), ("O", "Q"), ("D", "O"), ("P", "F"), ("d", "cl"), ("cl", "d"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("u", "ii"), ("in", "m"),
    ("ri", "n"), ("n", "ri"), ("h", "li"), ("li", "h"), ("nn", "m"), ("s", "8"), ("a", "u"), ("r", "i"), ("j", "i"), ("k", "lc"),
]
# Letters that stand for digits, and these.
LIKE_DIGITS = "lIiOoSsBbZgq"
AS_DIGITS = "111005586299"
_HYPHENS = "-‐‑‒­¬"
# Signs that stand alone in no printed text but this often at most, in shares of all words.
STRAY = "_~^°»«•■□▪|\\\\¦¤`´¨"
_STRAY = re.compile(rf"(?<!\S)[{STRAY}]+(?!\S)")
_BROKEN = re.compile(rf"(?<![^\W\d_])([^\W\d_]+)([{_HYPHENS}])(?:[ \t]*\n[ \t]*|[ \t]+)([^\W\d_]+)")
_SOFT = re.compile(r"(?<![^\W\d_])([^\W\d_]+)([‐­¬])()([^\W\d_]+)")
_TOKEN = re.compile(r"\w+(?:[!|¡](?=[a-z])\w*)*|(?:[!|¡](?=[a-z])\w*)+")
# one pattern a hyphen: what begins with one literal sign is looked for much faster than a class
_LINE_HYPHENS = [(h, re.compile(rf"{h}\s")) for h in _HYPHENS]
_SIGNS = "‐­¬"


def take_apart(text: str, remover: Remover, doc: str | None = None, page: int | None = None, granted: frozenset = frozenset()) -> tuple[set[str], str, list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(kinds of furniture seen, running text, divided words as (left, hyphen, right), questions about the document's furniture).

    In the running text heads and page numbers are gone, line ends are kept,
    and each divided word is a slot ``\\x00<number>\\x00``.
    """
    kinds, body, asks = remover.strip(text, doc, page, granted)
    divided: list[tuple[str, str, str]] = []

    def slot(m: re.Match) -> str:
        left, hyphen, right = m[1], m[2], m[m.lastindex]
        if not right[0].islower() or right in ("and", "or", "to") and m.re is _BROKEN:
            return m[0]
        divided.append((left, hyphen, right))
        return f"\x00{len(divided) - 1}\x00"

    body = body.strip().replace("\x00", " ")
    if any(h in body and at_end.search(body) for h, at_end in _LINE_HYPHENS):
        body = _BROKEN.sub(slot, body)
    if any(x in body for x in _SIGNS):
        body = _SOFT.sub(slot, body)
    return kinds, body, divided, asks


_SLOTS = re.compile("\x00(\\d+)\x00")


def _plain(body: str) -> str:
    return _SLOTS.sub(" ", body)


def _forms(texts: DataFrame) -> DataFrame:
    """(form, n): counts of word forms, of compounds written ``a-b`` within a line, and of signs that stand alone.

    A blank ends every form, so texts are divided at blanks first: each
    distinct piece is taken apart once and counts as often as it was met.
    """
    pieces = texts.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("piece")).groupBy("piece").agg(F.count("*").alias("k"))
    words = F.regexp_extract_all("piece", F.lit(rf"[\p{{L}}\p{{N}}_]+(?:[!|¡](?=[a-z])[\p{{L}}\p{{N}}_]*)*|(?:[!|¡](?=[a-z])[\p{{L}}\p{{N}}_]*)+|(?<!\S)[{STRAY}]+(?!\S)"), F.lit(0))
    joined = F.regexp_extract_all("piece", F.lit(r"(?<![\p{L}\p{N}-])\p{L}+-\p{L}+(?![\p{L}\p{N}-])"), F.lit(0))
    forms = F.concat(words, F.when(F.contains("piece", F.lit("-")), F.transform(joined, F.lower)).otherwise(F.array()))
    return pieces.select(F.explode(forms).alias("form"), "k").groupBy("form").agg(F.sum("k").alias("n"))


def _anagram(form: Column) -> Column:
    """Sum of the fifth powers of the signs' codes (below 4,093): equal for forms of the same signs in any order."""

    def fifth(c: Column) -> Column:
        x = F.pmod(F.ascii(c), F.lit(4093)).cast("long")
        return x * x * x * x * x

    return F.aggregate(F.split(form, ""), F.lit(0).cast("long"), lambda a, c: a + fifth(c))


def misread_forms(forms: DataFrame, ratio: int = 12, least: int = 12, split_ratio: int = 50, stray_share: float = 0.001) -> DataFrame:
    """(form, fixed): forms that are another, ``ratio`` times as frequent form but for one confusable pair,
    or two frequent forms without the space between them. The most frequent candidate wins, then the first in order.

    No printed word has digits or bars among its letters, so such a form only
    must be no more frequent than the clean one, and if its clean one is not
    known either, its kind (letters and digits made one) must be rare beside
    the clean kind. Numbers, rarely met twice, are compared by kind alone.
    Signs that stand alone are misread nothings while they are rare.
    """
    spark = forms.sparkSession
    words = forms.where(F.col("form").rlike(r"^[\p{L}\p{N}!|¡]+$") & F.col("form").rlike(r"\p{L}"))
    known = words.where((F.col("n") >= 2) & F.col("form").rlike(r"^\p{L}+$"))
    clean = known.where(F.col("n") >= least)
    titled = clean.where(F.col("form").rlike(r"^\p{Ll}")).select(F.initcap("form").alias("form"), "n")
    frequent = clean.unionByName(titled).groupBy("form").agg(F.max("n").alias("n"))
    candidates = known.unionByName(titled).groupBy("form").agg(F.max("n").alias("n"))
    goods = candidates.select(F.col("form").alias("good"), F.col("n").alias("good_n"), _anagram(F.col("form")).alias("h"))
    code = lambda s: sum((ord(c) % 4093) ** 5 for c in s)
    pairs = spark.createDataFrame([(a, b, code(a) - code(b)) for a, b in CONFUSED], "printed string, seen string, d long")
    # what is as frequent as the commonest clean form allows is no rare form
    top = frequent.agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    mixed = F.col("form").rlike("[0-9!|¡]")
    rare = words.where(F.length("form") > 1).select("form", "n", mixed.alias("mixed"), _anagram(F.col("form")).alias("own"))
    rare = rare.crossJoin(F.broadcast(top)).where(F.col("mixed") | (F.col("n") * ratio <= F.col("top"))).drop("top")
    shifted = rare.crossJoin(F.broadcast(pairs)).where(F.instr("form", F.col("seen")) > 0).withColumn("h", F.col("own") + F.col("d"))  # len(CONFUSED) rows a form at most
    need = F.when(F.length("form") <= 3, 10 * ratio).otherwise(ratio)
    beaten = (F.col("good_n") >= least) & (F.col("good_n") >= need * F.col("n"))
    met = shifted.join(goods, "h").where(beaten | (F.col("mixed") & (F.length("form") > 3) & (F.col("good_n") >= F.col("n"))))
    at = F.sequence(F.lit(1), F.length("good"))
    same = F.exists(
        at,
        lambda i: (F.substr("good", i, F.length("printed")) == F.col("printed"))
        & (F.concat(F.substr("good", F.lit(1), i - 1), F.col("seen"), F.substr("good", i + F.length("printed"))) == F.col("form")),
    )
    swaps = met.where(same).select("form", F.col("good").alias("fixed"), "good_n")
    cuts = rare.where(F.col("form").rlike(r"^\p{L}{4,}$")).select("form", "n", F.explode(F.sequence(F.lit(1), F.length("form") - 1)).alias("i"))
    halves = cuts.select("form", "n", F.substr("form", F.lit(1), F.col("i")).alias("a"), F.substr("form", F.col("i") + 1).alias("b"))
    # a word of one letter is the article only
    halves = halves.where(((F.length("a") > 1) | F.col("a").isin("a", "A")) & ((F.length("b") > 1) | (F.col("b") == "a")))
    left, right = frequent.select(F.col("form").alias("a"), F.col("n").alias("na")), frequent.select(F.col("form").alias("b"), F.col("n").alias("nb"))
    two = halves.join(left, "a").where(F.col("na") >= split_ratio * F.col("n")).join(right, "b").where(F.col("nb") >= split_ratio * F.col("n"))
    splits = two.select("form", F.concat_ws(" ", "a", "b").alias("fixed"), F.least("na", "nb").alias("good_n"))
    # kinds: letters are a, digits 0; a number's misread signs shift its hash by the sum of their differences
    kind = F.regexp_replace(F.regexp_replace("form", r"\p{L}", "a"), "[0-9]", "0")
    digits = forms.where(F.col("form").rlike(rf"^[0-9{LIKE_DIGITS}]*[0-9][0-9{LIKE_DIGITS}]*$")).select("form", "n", F.regexp_replace("form", "[0-9]", "0").alias("kind"))
    digits = digits.where(~F.col("kind").rlike("^0+[Bs]$"))  # a last B numbers a section, a last s makes a decade
    number = F.translate("kind", LIKE_DIGITS, "0" * len(LIKE_DIGITS))
    by_kind = digits.groupBy("kind").agg(F.sum("n").alias("kn")).withColumn("h", _anagram(number))
    whole = by_kind.where(F.col("kind").rlike("^0+$")).select("h", F.col("kn").alias("good_n"))
    odd = by_kind.where(~F.col("kind").rlike("^0+$")).join(whole, "h").where(F.col("good_n") >= ratio * F.col("kn")).select("kind", "good_n")
    numbers = digits.join(odd, "kind").select("form", F.translate("form", LIKE_DIGITS, AS_DIGITS).alias("fixed"), "good_n")
    letters = F.length(F.regexp_replace("form", r"\P{L}", ""))
    inner = words.where(mixed & (letters >= 3) & (F.length("form") - letters <= 2)).select("form", "n", kind.alias("kind"))
    clean_kind = words.where(~mixed).groupBy(F.length("form").alias("l")).agg(F.sum("n").alias("good_n"))
    by_inner = inner.groupBy("kind").agg(F.sum("n").alias("kn")).withColumn("l", F.length("kind"))
    rare_kind = by_inner.join(clean_kind, "l").where(F.col("good_n") >= ratio * F.col("kn")).select("kind")
    inner = inner.join(rare_kind, "kind").select("form", F.col("form").alias("fixed"), F.lit(0).cast("long").alias("good_n"))
    all_n = forms.agg(F.sum("n").alias("all_n"))
    signs = forms.where(F.col("form").rlike(rf"^[{STRAY}]+$")).crossJoin(F.broadcast(all_n)).where(F.col("n") <= stray_share * F.col("all_n"))
    signs = signs.select("form", F.lit("").alias("fixed"), F.col("all_n").alias("good_n"))
    best = F.min(F.struct((-F.col("good_n")).alias("k"), F.col("fixed").alias("f")))
    every = swaps.unionByName(splits).unionByName(numbers).unionByName(inner).unionByName(signs)
    return every.groupBy("form").agg(best.alias("m")).select("form", F.col("m.f").alias("fixed"))


class OpenWords:
    """The words and lone signs of running texts that must be asked about; one per process.

    Whitespace ends every word, so what a piece between blanks asks is found
    once and kept.
    """

    def __init__(self, common: frozenset[str], most: int = 100_000):
        self.common = common
        self.most = most
        self.settled: set[str] = set()  # pieces that ask nothing
        self.asking: dict[str, list[str]] = {}

    def of(self, plain: str) -> set[str]:
        found: set[str] = set()
        for piece in set(plain.split()) - self.settled:
            asks = self.asking.get(piece)
            if asks is None:
                asks = [x for x in {*_TOKEN.findall(piece), *_STRAY.findall(piece)} if x not in self.common and not x.isdigit()]
                if len(self.settled) + len(self.asking) >= self.most:
                    self.settled.clear()
                    self.asking.clear()
                if asks:
                    self.asking[piece] = asks
                else:
                    self.settled.add(piece)
            found.update(asks)
        return found


def _asked(texts: DataFrame, common: frozenset[str], heads: Heads) -> DataFrame:
    """One row per open question of a text: (key, kind, ask): ``kind`` found already (ask null), or what must be asked."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remover, words = Remover(heads), OpenWords(common)
        for b in batches:
            keys, kinds, asks = [], [], []
            for key, doc, page, t in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "page", "text"))):
                seen, body, divided, more = take_apart(t, remover, doc, page)
                open_ = [("misread", x) for x in words.of(_plain(body) if divided else body)]
                open_ += [("hyphenation", f"{x}-{y}".lower() + ("" if h == "-" else "!")) for x, h, y in divided]
                open_ = list(dict.fromkeys(open_ + more))
                keys += [key] * (len(seen) + len(open_))
                kinds += sorted(seen) + [k for k, _ in open_]
                asks += [None] * len(seen) + [a for _, a in open_]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(asks, pa.string())], ["key", "kind", "ask"])

    return texts.select("key", "doc", "page", "text").mapInArrow(ask, "key string, kind string, ask string")


def divided_words(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """(kind, ask, fixed) of the words with a hyphen at a line end, kept or lost, that are not compounds:
    the whole word is more frequent than the compound, or neither is known."""
    open_ = asked.where("kind = 'hyphenation' AND ask IS NOT NULL").select("kind", "ask").distinct()
    hyphened = F.rtrim(F.col("ask"), F.lit("!"))
    open_ = open_.select("kind", "ask", hyphened.alias("c"), F.replace(hyphened, F.lit("-"), F.lit("")).alias("w"))
    lower = forms.where(F.col("form").rlike(r"^[\p{L}-]+$")).groupBy(F.lower("form").alias("form")).agg(F.sum("n").alias("n"))
    one, two = lower.select(F.col("form").alias("w"), F.col("n").alias("nw")), lower.select(F.col("form").alias("c"), F.col("n").alias("nc"))
    met = open_.join(one, "w", "left").join(two, "c", "left").na.fill(0, ["nw", "nc"])
    return met.where((F.col("nw") > F.col("nc")) | (F.col("nc") == 0)).select("kind", "ask", F.col("w").alias("fixed"))


def _answers(texts: DataFrame, common_forms: int) -> tuple[DataFrame, DataFrame, Heads]:
    """(open questions of all texts, answers (kind, ask, fixed), heads)."""
    heads, furniture = learn(texts, CONFUSED)
    forms = cut(_forms(texts))
    bad = cut(misread_forms(forms))
    good = forms.where(F.col("form").rlike("^[A-Za-z]+$")).join(bad, "form", "left_anti").orderBy(F.desc("n"), "form").limit(common_forms)
    # a bounded set that only spares questions: forms outside it are asked
    common = frozenset(r.form for r in good.select("form").collect())
    asked = cut(_asked(texts, common, heads))
    misread = bad.select(F.lit("misread").alias("kind"), F.col("form").alias("ask"), "fixed")
    # a document's print or offset is asked for a head and a number alike
    told = furniture.select(F.explode(F.array(F.lit("header"), F.lit("page_number"))).alias("kind"), "ask", F.lit("").alias("fixed"))
    return asked, misread.unionByName(divided_words(asked, forms)).unionByName(told), heads


def _texts(df: DataFrame, id_col: str, text_col: str, doc_col: str | None, page_col: str | None) -> DataFrame:
    """(key, doc, page, text) of the rows with an id and a text; a row without a document is one of its own."""
    key = F.col(id_col).cast("string")
    doc = F.coalesce(F.lower(F.trim(F.col(doc_col).cast("string"))), key) if doc_col else key
    page = F.col(page_col).cast("int") if page_col else F.lit(None).cast("int")
    return spread(df.select(key.alias("key"), doc.alias("doc"), page.alias("page"), F.col(text_col).cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL"))


def scan_noise(df: DataFrame, id_col: str, text_col: str, doc_col: str | None = None, page_col: str | None = None, common_forms: int = 30_000) -> DataFrame:
    """(id, noise_kind), distinct: what kinds of damage the texts of an id hold.

    ``doc_col`` and ``page_col`` name the document and the page a text is of;
    without them heads are learned from all texts together and numbers are not
    compared with pages. Null ids, null and empty texts give no row; rows of
    one id count together.
    """
    asked, answers, _ = _answers(_texts(df, id_col, text_col, doc_col, page_col).where("text <> ''"), common_forms)
    told = asked.where("ask IS NULL").select("key", "kind")
    found = asked.where("ask IS NOT NULL").join(answers, ["kind", "ask"]).select("key", "kind")
    return told.unionByName(found).distinct().select(F.col("key").alias("id"), F.col("kind").alias("noise_kind"))


def repair_scans(df: DataFrame, id_col: str, text_col: str, doc_col: str | None = None, page_col: str | None = None, common_forms: int = 30_000) -> DataFrame:
    """(id, text): each text once per id as continuous paragraphs, without furniture, divided and misread words.

    Paragraphs stay apart at empty lines; other line ends become blanks. Null
    ids and null texts give no row; an empty text stays empty.
    """
    rows = _texts(df, id_col, text_col, doc_col, page_col)
    asked, answers, heads = _answers(rows.where("text <> ''"), common_forms)
    fixes = asked.where("ask IS NOT NULL").join(answers, ["kind", "ask"]).groupBy("key").agg(F.collect_set(F.struct("kind", "ask", "fixed")).alias("fixes"))
    # the texts move once: the rows of a key meet, are told apart by hash and find their fixes there
    once = rows.withColumn("h", F.xxhash64("text")).repartition("key").dropDuplicates(["key", "h"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remover = Remover(heads)
        for b in batches:
            done = []
            for doc, page, t, fx in zip(*(b.column(c).to_pylist() for c in ("doc", "page", "text", "fixes"))):
                done.append(repair(t, {(f["kind"], f["ask"]): f["fixed"] for f in fx or []}, remover, doc, page))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(done, pa.string())], ["id", "text"])

    return once.join(fixes, "key", "left").select("key", "doc", "page", "text", "fixes").mapInArrow(mend, "id string, text string")


def repair(text: str, fixes: dict[tuple[str, str], str], remover: Remover, doc: str | None = None, page: int | None = None) -> str:
    """``text`` with its furniture gone and ``fixes`` (answers to its questions) applied."""
    _, body, divided, _ = take_apart(text, remover, doc, page, frozenset(fixes))
    body = _STRAY.sub(lambda m: fixes.get(("misread", m[0]), m[0]), body)

    def whole(m: re.Match) -> str:
        x, h, y = divided[int(m[1])]
        is_divided = ("hyphenation", f"{x}-{y}".lower() + ("" if h == "-" else "!")) in fixes
        return x + y if is_divided else f"{x}-{y}"

    body = _TOKEN.sub(lambda m: fixes.get(("misread", m[0]), m[0]), body)
    body = _SLOTS.sub(whole, body)
    paragraphs = re.split(r"\n[ \t]*\n\s*", body)
    return "\n\n".join(p for p in (re.sub(r"\s+", " ", p).strip() for p in paragraphs) if p)

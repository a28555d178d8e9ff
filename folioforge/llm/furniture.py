"""Page furniture: running heads and page numbers, told from the text by where their lines stand and by their recurrence.

Nothing here knows what a head says. A line is an *edge line* if it stops short
of the column although more would have fitted (so no wrapping of prose made
it), and it *interrupts* if the sentence before it goes on after it. Edge lines
are reduced to prints without digits and with the signs that recognition
confuses made one, and to templates in which the words of single documents
become classes (``A`` for capitals, ``Aa`` for a capital first letter). A
template is a head's if its lines interrupt sentences in several documents;
section headings and last lines of paragraphs recur as well but never
interrupt. What is learned is then removed wherever it stands, in lines or lost
in running text. A number alone is a page number by the same evidence, or if it
runs with the pages of its document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut

_NUM = re.compile(r"(?<![^\W_])[0-9lIOoSBZ]*[0-9][0-9lIOoSBZ]*(?![^\W_])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"['’]")
_SPACES = re.compile(r"\s{2,}|\t")
_LINE = re.compile(r"\r\n|\r|\n")
_ENDED = re.compile(r"[.?!:;][\"'”’)\]]*$")
_PAGE_WORDS = {"p", "pp", "pg", "page", "pages", "of"}
_DIGITS = str.maketrans("lIOoSBZ", "1100582")
_FIRST = re.compile(r"\s*([0-9lIOoSBZ]*[0-9][0-9lIOoSBZ]*)\s+(?=[A-Z])")
_LAST = re.compile(r"(?<=[.;:,?!\"”)])\s+([0-9lIOoSBZ]*[0-9][0-9lIOoSBZ]*)\s*$")
_SEED = re.compile(r"[A-Z](?:[A-Z]{2}|\.[A-Z0-9])")
_LOW = re.compile(r"[a-km-z]")  # l is often a misread I
_NEXT = re.compile(r"\s+[^\sa-km-z]+(?!\S)")
CLASSES = ("A", "Aa", "a")


def lines_of(text: str) -> list[str]:
    return _LINE.split(text) if "\r" in text else text.split("\n")


def numbered(text: str, by: str = "#") -> str:
    """``text`` with ``by`` for its numbers."""
    return _NUM.sub(by, text) if _DIGIT.search(text) else text


def confusion_fold(pairs: list[tuple[str, str]]) -> dict[int, str]:
    """One sign for all capitals and digits that ``pairs`` (printed, seen) let stand for each other."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if len(a) == len(b) == 1 and all(c.isupper() or c.isdigit() or c in "|!" for c in (a, b)):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {ord(x): root(x) for x in list(up)}


def folded(word: str, fold: dict[int, str]) -> str:
    """A word in capitals (but for one sign at most) as its print; other words stay."""
    if word.islower() or word[1:].islower() and len(word) > 3:
        return word
    high = sum(c.isupper() or c.isdigit() for c in word)
    return word.upper().translate(fold) if high >= len(word) - (len(word) > 2) and any(c.isupper() for c in word) else word


def reduced(token: str, literal: frozenset[str], fold: dict[int, str]) -> list[str]:
    """A token as it stands in templates: with the literal words, and with short words only."""

    def replace(m: re.Match, all_words: bool) -> str:
        w = m[0]
        g = folded(w, fold)
        if len(w) <= 3 or all_words and g in literal:
            return g
        return "A" if g.isupper() else "Aa" if w[0].isupper() else "a"

    found = []
    for all_words in True, False:
        t = _WORD.sub(lambda m: replace(m, all_words), token)
        bare = t.rstrip(",.")
        found.append(bare if bare in CLASSES else t)
    return found


def templates(segment: str, literal: frozenset[str], fold: dict[int, str], known: dict[str, list[str]] | None = None) -> list[str]:
    """A segment's templates, finest first: with the literal words, with short words only, and with one literal word each.

    ``known`` keeps the tokens reduced before, of the same ``literal`` and ``fold``.
    """
    fine: list[str] = []
    short: list[str] = []
    known = {} if known is None else known
    if len(known) > 100_000:
        known.clear()
    for token in numbered(_MARKS.sub("", segment)).split():
        both = known.get(token)
        if both is None:
            both = known[token] = reduced(token, literal, fold)
        for out, t in zip((fine, short), both):
            if not out or out[-1] != t or t not in CLASSES:
                out.append(t)
    found = [" ".join(fine), " ".join(short)]
    if "a" not in short and segment.upper() == segment:  # a line of capitals around one word
        for i, t in enumerate(fine):
            if t not in CLASSES and t != "#" and 0 < i < len(fine) - 1:
                found.append(f"A… {t} …A")
        ends = [t for t in (fine[0], fine[-1]) if "#" in t]
        if ends and len(fine) > 2:
            found.append(f"{fine[0]} …A" if "#" in fine[0] else f"A… {fine[-1]}")
    elif len(fine) > 2 and not fine[-1].isalpha() and "#" not in fine[-1]:  # what ends in a sign of its own, as a bracket
        found.append(f"Aa… {' '.join(fine[-2:])}")
    return list(dict.fromkeys(found))


def print_of_line(line: str, fold: dict[int, str]) -> str:
    """A line without digits, blanks and signs, confusable signs made one."""
    return "".join(folded(w, fold).upper() for w in _WORD.findall(numbered(line, "")))


def number_of(segment: str) -> int | None:
    """The page number a segment consists of, if it is nothing else: signs and words for "page" beside it only."""
    if not _DIGIT.search(segment):
        return None
    numbers = _NUM.findall(segment)
    rest = _NUM.sub("", segment)
    if not 1 <= len(numbers) <= 2 or any(w.lower() not in _PAGE_WORDS for w in _WORD.findall(rest)):
        return None
    if len(numbers) == 2 and " of " not in f" {' '.join(_WORD.findall(rest)).lower()} ":
        return None
    if segment[-1:] in ",;:" or segment[-1:] == "." and segment[:1] != "." or re.search(r"[/#%$]|[-–—]\S*\d\S*[-–—]", segment):
        return None
    digits = numbers[0].translate(_DIGITS)
    return int(digits) if digits.isdigit() and len(digits) <= 5 else None


@dataclass(frozen=True)
class Edge:
    """An edge line: its number, its segments, whether its block interrupts a sentence, whether it stops short (or cannot be prose: all capitals, or ends in a bracket)."""

    at: int
    segments: list[str]
    interrupts: bool
    short: bool


def edge_lines(lines: list[str]) -> list[Edge]:
    """The lines of a text that prose did not wrap: those that stop short, and those whose words all have a capital."""
    full = [(i, s) for i, s in ((i, x.strip()) for i, x in enumerate(lines)) if s]
    if len(full) < 2:
        return []
    sizes = sorted(len(s) for _, s in full)
    width = sizes[-(-3 * (len(sizes) - 1) // 4)]
    marks = [0] * len(full)
    following = ""
    for k in range(len(full) - 1, -1, -1):
        s = full[k][1]
        # a line that begins in lower case or ends in a comma goes on with a sentence
        goes_on = s[0].islower() and not (s[0] in "plo" and number_of(s) is not None) or s[-1] in ",;" or s[-1] in "-‐‑‒¬\xad" and s[-2:-1].isalpha()
        if not goes_on and k == len(full) - 1:
            marks[k] = 1
        elif not goes_on:
            if len(s) + 1 + len(following.split(None, 1)[0]) <= width:
                marks[k] = 2
                continue
            if not s[-1].islower():
                long = [w for w in _WORD.findall(numbered(s, "")) if len(w) > 3]
                if 3 * sum(w[0].islower() for w in long) <= len(long):
                    marks[k] = 3 if s[-1] == ")" or s == s.upper() else 1
                    continue
        following = s
    out: list[Edge] = []
    k = 0
    while k < len(full):
        if not marks[k]:
            k += 1
            continue
        end = k
        while end < len(full) and marks[end]:
            end += 1
        before = full[k - 1][1] if k else ""
        after = full[end][1] if end < len(full) else ""
        interrupts = bool(before) and bool(after) and after[0].islower() and not _ENDED.search(before)
        for j in range(k, end):
            i, s = full[j]
            out.append(Edge(i, [x for x in _SPACES.split(s) if x], interrupts, marks[j] > 1))
        k = end
    return out


@dataclass(frozen=True)
class Heads:
    """What was learned: templates of furniture, and finer ones that are none; the words kept in templates."""

    literal: frozenset[str] = frozenset()
    accepted: frozenset[str] = frozenset()
    rejected: frozenset[str] = frozenset()
    fold: dict[int, str] = field(default_factory=dict)

    def verdict(self, segment: str, known: dict[str, list[str]] | None = None) -> int:
        """1 if a template says furniture and no finer one that it is none, -1 if the finest says that it is none, else 0."""
        for i, t in enumerate(templates(segment, self.literal, self.fold, known)):
            if t in self.accepted:
                return 1
            if t in self.rejected:
                return -1 if i == 0 else 0
        return 0

    def known(self, segment: str) -> bool:
        return self.verdict(segment) > 0


def _docs(texts: DataFrame, fold: dict[int, str]) -> DataFrame:
    """(doc, page, segment, is_number, evidence, n): edge segments with digits made ``#``, once per batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for doc, page, t in zip(b.column("doc").to_pylist(), b.column("page").to_pylist(), b.column("text").to_pylist()):
                for e in edge_lines(lines_of(t)):
                    for s in e.segments:
                        number = number_of(s)
                        offset = number - page if number is not None and page is not None else None
                        found[doc, page, numbered(s), offset, e.interrupts and e.short] += 1
            rows = list(found)
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([found[r] for r in rows], pa.int64())], ["doc", "page", "segment", "offset", "evidence", "n"])

    lined = texts.where(F.col("text").rlike("[\r\n]")).select("doc", "page", "text")
    return lined.mapInArrow(scan, "doc string, page int, segment string, offset int, evidence boolean, n long")


def learn(texts: DataFrame, pairs: list[tuple[str, str]], word_share: float = 0.02, template_share: float = 0.0005, least_docs: int = 3, least_evidence: float = 0.15) -> tuple[Heads, DataFrame]:
    """(heads, evidence of documents) from texts (doc, page, text).

    A word stays in templates if edge lines of at least ``word_share`` of the
    documents have it; a template counts if at least ``template_share`` of the
    documents (and ``least_docs``) have it, and is furniture if at least
    ``least_evidence`` of its lines interrupt a sentence. Both sets are bounded
    by the edge lines of an average document over those shares. The second
    result, (ask), holds what single documents tell: ``doc|print`` of lines
    that recur on several of its pages and interrupt there, and ``doc|offset``
    of numbers that run with its pages.
    """
    fold = confusion_fold(pairs)
    edges = cut(_docs(texts, fold))
    docs = edges.agg(F.count_distinct("doc").alias("n")).first().n
    if not docs:
        return Heads(fold=fold), edges.select(F.lit("").alias("ask")).limit(0)

    def spread(make: Callable[[str], list[str]]) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen: dict[tuple, list[int]] = {}
                for doc, s, ev, n in zip(*(b.column(c).to_pylist() for c in ("doc", "segment", "evidence", "n"))):
                    for t in make(s):
                        z = seen.setdefault((doc, t), [0, 0])
                        z[0] += n
                        z[1] += n * ev
                keys = list(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
                    ["doc", "t", "n", "e"],
                )

        per_doc = edges.select("doc", "segment", "evidence", "n").mapInArrow(each, "doc string, t string, n long, e long").groupBy("t", "doc").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
        return per_doc.groupBy("t").agg(F.count("*").alias("docs"), F.count_if(F.col("e") > 0).alias("told"), F.sum("n").alias("n"), F.sum("e").alias("e"))

    words = spread(lambda s: list({folded(w, fold) for w in _WORD.findall(_MARKS.sub("", s))}))
    literal = frozenset(r.t for r in words.where(F.col("docs") >= max(least_docs, int(word_share * docs))).select("t").collect())  # bounded by word_share
    counted = spread(lambda s: templates(s, literal, fold)).where(F.col("docs") >= max(least_docs, int(template_share * docs)))
    rows = counted.select("t", "n", (F.col("e") / F.col("n")).alias("share"), "told").collect()  # bounded by template_share
    bare = {*CLASSES}
    accepted = frozenset(r.t for r in rows if r.share >= least_evidence and r.told >= 2 and r.t not in bare)
    rejected = frozenset(r.t for r in rows if r.share < least_evidence / 3 and r.n >= 12)  # fewer heads could all stand where nothing is interrupted

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [print_of_line(s, fold) for s in b.column("segment").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("page"), pa.array(p, pa.string()), b.column("evidence")], ["doc", "page", "print", "evidence"])

    named = edges.where("offset IS NULL AND page IS NOT NULL").select("doc", "page", "segment", "evidence").mapInArrow(prints, "doc string, page int, print string, evidence boolean")
    repeated = named.where("print <> ''").groupBy("doc", "print").agg(F.count_distinct("page").alias("pages"), F.count_if("evidence").alias("e")).where("pages >= 2 AND e >= 1")
    run = edges.where("offset IS NOT NULL").groupBy("doc", "offset").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")
    asks = repeated.select(F.concat_ws("|", "doc", "print").alias("ask")).unionByName(run.select(F.concat_ws("|", "doc", F.col("offset").cast("string")).alias("ask")))
    return Heads(literal, accepted, rejected, fold), asks


def capitals(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words without small letters around a word of three capitals or an abbreviation of two."""
    at = 0
    while m := _SEED.search(text, at):
        a, b = m.span()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if not _LOW.search(text, a, b):
            while n := _NEXT.match(text, b):
                b = n.end()
            while True:
                e = a
                while e > at and text[e - 1].isspace():
                    e -= 1
                c = e
                while c > at and not text[c - 1].isspace():
                    c -= 1
                if c == e or _LOW.search(text, c, e):
                    break
                a = c
            yield a, b
        at = b


class Remover:
    """Removes what ``Heads`` knows from texts; one per process."""

    def __init__(self, heads: Heads):
        self.heads = heads
        self.said: dict[str, int] = {}  # verdicts on segments met in this process, without digits
        self.reduced: dict[str, list[str]] = {}  # tokens of such segments, as templates have them
        flat = [t for t in heads.accepted if "…" not in t and len(t.split()) > 1]
        self.most = max((len(t.split()) for t in flat), default=0) + 8
        # last tokens with a sign of their own, by which heads in mixed case are found in running text
        ends = {t.split()[-1] for t in heads.accepted if not t.isupper() and re.search(r"[A-Za-z]", t.split()[-1]) and t.split()[-1] not in CLASSES and t.split()[-1][-1] in ")]"}
        mid = "|".join(re.escape(x) for x in sorted(ends))
        self.end = re.compile(rf"(?:{mid})(?!\S)") if ends else None
        self.links = {x for t in heads.accepted if not t.isupper() for x in t.split() if x[:1].islower() and x not in CLASSES} | {"of", "and", "&"}

    def verdict(self, segment: str) -> int:
        print_ = numbered(segment)
        said = self.said.get(print_)
        if said is None:
            if len(self.said) > 100_000:
                self.said.clear()
            said = self.said[print_] = self.heads.verdict(print_, self.reduced)
        return said

    def line_kinds(self, e: Edge) -> set[str]:
        """The kinds of furniture an edge line is: by its own place, or by its segments: one is known, and none is known to be none."""
        kinds = {"page_number" if number_of(s) is not None else "header" for s in e.segments}
        if e.interrupts and e.short:
            return kinds
        says = [self.verdict(s) for s in e.segments]
        named = [v for v, s in zip(says, e.segments) if number_of(s) is None]
        return kinds if min(says) >= 0 and max(named or says) > 0 else set()

    def strip(self, text: str, doc: str | None = None, page: int | None = None, granted: frozenset = frozenset()) -> tuple[set[str], str, list[tuple[str, str]]]:
        """(kinds, text without furniture, open questions (kind, ask) about this document's own evidence).

        What was asked before and is in ``granted`` goes as well.
        """
        kinds: set[str] = set()
        asks: list[tuple[str, str]] = []
        lines = lines_of(text)
        if len(lines) > 1:
            gone = set()
            for e in edge_lines(lines):
                got = self.line_kinds(e)
                if got:
                    kinds |= got
                    gone.add(e.at)
                elif doc is not None:
                    mine = []
                    for s in e.segments:
                        number = number_of(s)
                        if number is None:
                            mine.append(("header", f"{doc}|{print_of_line(s, self.heads.fold)}"))
                        elif page is not None:
                            mine.append(("page_number", f"{doc}|{number - page}"))
                    asks += mine
                    if any(x in granted for x in mine):
                        gone.add(e.at)
            text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        else:
            m = _FIRST.match(text) or _LAST.search(text, max(0, len(text) - 24))
            if m and doc is not None and page is not None and (n := number_of(m[1])) is not None:
                asks.append(("page_number", f"{doc}|{n - page}"))
                if asks[-1] in granted:
                    text = text[: m.start(1)] + "\n" + text[m.end(1) :]
        if self.heads.accepted:
            text = self._running(text, kinds)
        return kinds, text, asks

    def _running(self, text: str, kinds: set[str]) -> str:
        spans = []
        for a, b in capitals(text):
            spans += self._within(text, a, b)
        if self.end:
            for m in self.end.finditer(text):
                begin = m.start()
                if begin and not text[begin - 1].isspace():
                    continue
                tokens = 0
                while begin > 0 and tokens < self.most:
                    prev = re.search(r"(\S+)\s+$", text[max(0, begin - 80) : begin])
                    if not prev or not (prev[1][0].isupper() or prev[1][0] in "([" or prev[1] in self.links):
                        break
                    begin -= len(prev[0])
                    tokens += 1
                found = self._within(text, begin, m.end(), last=True)
                spans += found
        if not spans:
            return text
        out, at = [], 0
        for a, b in sorted(spans):
            if a < at:
                continue
            for s in _SPACES.split(text[a:b]):
                kinds.add("page_number" if number_of(s) is not None else "header")
            out += [text[at:a], "\n"]
            at = b
        return "".join(out) + text[at:]

    def _within(self, text: str, a: int, b: int, last: bool = False) -> list[tuple[int, int]]:
        """The longest known runs of tokens in text[a:b], each of more than one token and of letters."""
        out = []
        for seg in re.finditer(r"(?:(?!\s{2,}|\t).)+", text[a:b]):
            tokens = [(a + seg.start() + m.start(), a + seg.start() + m.end()) for m in re.finditer(r"\S+", seg[0])]
            i = 0
            while i < len(tokens) - 1:
                for j in range(len(tokens) if last else min(len(tokens), i + self.most), i + 1, -1):
                    s = text[tokens[i][0] : tokens[j - 1][1]]
                    says = self.verdict(s) if s[-1] not in ",;:" and number_of(s) is None else 0
                    if says > 0:
                        out.append((tokens[i][0], tokens[j - 1][1]))
                    if says:
                        i = j - 1
                        break
                    if last:
                        break
                i += 1
        return out

"""Abusive, hateful and sexual content, by class-conditional Kneser-Ney models of sentences.

Reviewers label documents, but it is sentences that are offensive, so the
models are fitted in rounds on the labelled documents: every sentence belongs
to the class whose model gives it the best length-normalised likelihood, at
first guided by its document's label. The classes' trigram and bigram counts
are their own; what they back off to, the continuation counts of words, is
shared, so that an expression that one class never saw is not held for
another's.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import spread

CLASSES = ["abuse", "hate", "sexual"]
ORDINARY = len(CLASSES)

# Signs written for letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСХІЈЅКМТВНαονιρτυωκ", "aeopcyxijsdhkmtbhAEOPCXIJSKMTBHaovipTuwk")
_LEET = str.maketrans("013457@$!€|", "oieastasiel")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SPELLED = re.compile(r"(?<!\w)(\w)([ ._\-*]{1,2})(\w)(?:\2(\w)(?!\w)){1,}(?!\w)|(?<!\w)(?:\w[ ]){3,}\w(?!\w)")
_SPACED = re.compile(r"\b\w[ ._\-*]{1,2}\w[ ._\-*]{1,2}\w\b")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|\s[:;]-?[()]+\s+|[\r\n]+")
_KEEP = re.compile(r"(?:\b(?:v|vs|Dr|Mr|Mrs|Ms|St|No|Nos|Rs|Co|Ltd|J|M|Art)|\b[A-Z])\.$")
_WORD = re.compile(r"[\w@$!€|*']*[^\W_][\w@$!€|*']*|\*{2,}|[\"“”«»]")
_TURN = re.compile(r"^\s*[A-Za-z ]{2,20}:\s")
_NUMBER = re.compile(r"\d+[a-z]{0,2}")
_RUN = re.compile(r"(.)\1+")
_FORMS: dict[str, str] = {}  # forms of words met in this process


class _Lookup(dict):
    """A dict that makes what it misses; few calls of Python once it is filled."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


_BASE = _Lookup(lambda c: None if unicodedata.combining(chr(c)) else c)  # accents away


def _joined(m: re.Match) -> str:
    return re.sub(r"[\W_]+", "", m[0])


def sentences(text: str) -> list[str]:
    out: list[str] = []
    glue = False
    for s in _SPLIT.split(text):
        s = s.strip() if s else ""
        if not s:
            glue = False
            continue
        if glue:
            out[-1] += " " + s
        else:
            out.append(_TURN.sub("", s))
        glue = bool(_KEEP.search(s))
    return out


def words(sentence: str) -> list[str]:
    """Words without case, accents and disguises of spelling; numbers become ``0``, quotes ``"``."""
    s = sentence
    if not s.isascii():
        s = unicodedata.normalize("NFKC", _HIDDEN.sub("", s)).translate(_LOOKALIKE)
        s = unicodedata.normalize("NFD", s).translate(_BASE)
    if _SPACED.search(s):
        s = _SPELLED.sub(_joined, s)
    forms = _FORMS
    if len(forms) > 200_000:
        forms.clear()
    out = []
    for w in _WORD.findall(s):
        f = forms.get(w)
        if f is None:
            f = forms[w] = _form(w)
        if f:
            out.append(f)
    return out


def _form(w: str) -> str:
    w = w.strip("'!|").lower()
    if not w:
        return ""
    if w in "\"“”«»":
        return '"'
    if "*" in w:
        return w.strip("|")
    if w.isalpha():
        return _RUN.sub(r"\1", w)
    if _NUMBER.fullmatch(w):
        return "0"
    return _RUN.sub(r"\1", re.sub(r"[^\w*]+", "", w.translate(_LEET)))


class Model:
    """Interpolated Kneser-Ney trigrams of each class over shared continuation counts of words."""

    def __init__(self, least: int = 3, discount: float = 0.75):
        self.least, self.d = least, discount
        self.ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("token", "place", "rows", "made")} | {"ready": False}

    def _prepare(self) -> None:
        """Empty look-ups: written word to known form, trigram to its row of log-probabilities."""
        self.made = 0
        self.rows = np.empty((1024, len(self.tri)))

        def place(g: tuple[str, str, str]) -> int:
            if self.made == len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[self.made] = self._logs(g)
            self.made += 1
            return self.made - 1

        self.place = _Lookup(place)
        self.token = _Lookup(lambda w: (self._known([f]) if (f := _form(w)) else [""])[0])
        self.ready = True

    def fit(self, sents: list[list[str]], weight: list[int], classes: np.ndarray) -> "Model":
        n = len(CLASSES) + 1
        seen: Counter[str] = Counter()
        for s, k in zip(sents, weight):
            for w in s:
                seen[w] += k
        self.vocab = {w for w, k in seen.items() if k >= self.least}
        masked: dict[tuple[int, str], list[str]] = defaultdict(list)
        toxic: Counter[str] = Counter()
        for s, c, k in zip(sents, classes, weight):
            if c < ORDINARY:
                for w in s:
                    toxic[w] += k
        for w, k in toxic.items():
            if w in self.vocab and w.isalpha() and 2 * k > seen[w]:
                masked[w[0]].append(w)
        self.toxic = dict(masked)
        tri = [Counter() for _ in range(n)]
        for s, c, k in zip(sents, classes, weight):
            t = ["<s>", "<s>", *self._known(s), "</s>"]
            for g in zip(t, t[1:], t[2:]):
                tri[c][g] += k
        self.tri = [dict(t) for t in tri]
        self.ctx2, self.fol2, self.bi, self.ctx1, self.fol1 = [], [], [], [], []
        shared: Counter[str] = Counter()
        pairs = set()
        for t in tri:
            ctx2, fol2, bi = Counter(), Counter(), Counter()
            for (u, v, w), k in t.items():
                ctx2[u, v] += k
                fol2[u, v] += 1
                bi[v, w] += 1  # continuation count
                pairs.add((v, w))
            ctx1, fol1 = Counter(), Counter()
            for (v, w), k in bi.items():
                ctx1[v] += k
                fol1[v] += 1
            self.ctx2.append(dict(ctx2)), self.fol2.append(dict(fol2)), self.bi.append(dict(bi)), self.ctx1.append(dict(ctx1)), self.fol1.append(dict(fol1))
        for v, w in pairs:
            shared[w] += 1
        total, size = sum(shared.values()), len(self.vocab) + 3
        rest = 0.5 * len(shared) / max(total, 1) / size if shared else 1.0 / size
        self.uni = {w: (k - 0.5) / total + rest for w, k in shared.items()}
        self.floor = rest
        mass = np.bincount(classes, weights=weight, minlength=n) + 1.0
        self.prior = tuple(np.log(mass / mass.sum()))
        self.ready = False
        return self

    def _known(self, s: list[str]) -> list[str]:
        return [w if w in self.vocab else self._mask(w) if "*" in w else "<unk>" for w in s]

    def _mask(self, w: str) -> str:
        """A word with stars, read as the offensive word of its length and letters, if there is one."""
        if w[0] != "*":
            rx = re.compile(re.sub(r"\*", "[a-z]", _RUN.sub(lambda m: m[1] if m[1] != "*" else m[0], w)))
            for x in self.toxic.get(w[0], ()):
                if rx.fullmatch(x):
                    return x
        return "<mask>"

    def _logs(self, g: tuple[str, str, str]) -> tuple[float, ...]:
        u, v, w = g
        base = self.uni.get(w, self.floor)
        out = []
        for c in range(len(self.tri)):
            p = base
            n1 = self.ctx1[c].get(v)
            if n1:
                p = max(self.bi[c].get((v, w), 0) - self.d, 0) / n1 + self.d * self.fol1[c][v] / n1 * p
                n2 = self.ctx2[c].get((u, v))
                if n2:
                    p = max(self.tri[c].get(g, 0) - self.d, 0) / n2 + self.d * self.fol2[c][u, v] / n2 * p
            out.append(log(p))
        return tuple(out)

    def _sums(self, told: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods of each sentence of known words under each class and the ordinary model, lengths)."""
        ids: list[int] = []
        starts = []
        for t in told:
            starts.append(len(ids))
            t = ["<s>", "<s>", *t, "</s>"]
            ids += map(self.place.__getitem__, zip(t, t[1:], t[2:]))
        return np.add.reduceat(self.rows[ids], starts, axis=0), np.diff([*starts, len(ids)])

    def score(self, s: list[str]) -> tuple[list[float], int]:
        """Log-likelihoods of the sentence under each class and under the ordinary model, and its length."""
        if not self.ready:
            self._prepare()
        total, n = self._sums([self._known(s)])
        return total[0].tolist(), int(n[0])

    def judge(self, text: str, margin: float) -> tuple[list[float], set[int]]:
        """Best length-normalised log-likelihood ratio of each class over the sentences, and the classes found."""
        if not self.ready or self.made > 1_000_000 or len(self.token) > 500_000:
            self._prepare()
        plain = text.isascii() and not _SPACED.search(text)
        told = []
        for s in sentences(text):
            t = [x for w in _WORD.findall(s) if (x := self.token[w])] if plain else self._known(words(s))
            if t:
                told.append(t)
        if not told:
            return [-9.0] * ORDINARY, set()
        ll, n = self._sums(told)
        ratio = (ll[:, :ORDINARY] - ll[:, ORDINARY:]) / n[:, None]
        prior = np.array(self.prior)
        held = ll + prior
        top = held[:, :ORDINARY].argmax(1)
        at = np.arange(len(top))
        bad = (ratio[at, top] >= margin) & (held[at, top] > held[:, ORDINARY])
        return np.maximum(ratio.max(0), -9.0).tolist(), set(top[bad].tolist())


def fit(rows: list[tuple[str, str]], share: float = 0.62, rounds: int = 2) -> Model:
    """A model from (text, label) with labels of CLASSES or ``none``.

    Which sentences of the documents labelled offensive are so, the labels
    tell by their counts: of the documents with a trigram of the sentence, on
    average over its trigrams, more than ``share`` are labelled offensive.
    The others are ordinary; sentences of documents labelled ``none`` that
    pass the share are left out, as reviewers err. Then the models decide
    between the classes, and are fitted anew on that.
    """
    n = len(CLASSES) + 1
    kinds: dict[tuple[str, ...], np.ndarray] = {}
    docs = np.ones(n)
    for text, label in rows:
        c = CLASSES.index(label) if label in CLASSES else ORDINARY
        docs[c] += 1
        for s in set(sentences(text)):
            if w := tuple(words(s)):
                kinds.setdefault(w, np.zeros(n, np.int64))[c] += 1
    toks = [list(w) for w in kinds]
    if not toks:
        return Model().fit([], [], np.zeros(0, np.int64))
    by = np.array(list(kinds.values()))
    told, plain = by[:, :ORDINARY].sum(1), by[:, ORDINARY]
    marked, all_ = Counter(), Counter()
    padded = [["<s>", "<s>", *t, "</s>"] for t in toks]
    for t, k, m in zip(padded, told.tolist(), plain.tolist()):
        for g in zip(t, t[1:], t[2:]):
            marked[g] += k
            all_[g] += k + m
    lift = np.array([np.mean([(marked[g] + 0.3) / (all_[g] + 1) for g in zip(t, t[1:], t[2:])]) for t in padded])
    bad = lift > share
    at = np.where(bad, (by[:, :ORDINARY] / docs[:ORDINARY]).argmax(1), ORDINARY)
    weight = np.where(bad, told, told + plain)
    use = np.nonzero(weight)[0]
    model = Model()
    for r in range(rounds + 1):
        model = Model().fit([toks[i] for i in use], [int(weight[i]) for i in use], at[use])
        if r == rounds:
            break
        for i in use[bad[use]]:
            at[i] = int(np.add(model.score(toks[i])[0], model.prior)[:ORDINARY].argmax())
    return model


def labelled(documents: DataFrame, labels: DataFrame, most: int) -> list[tuple[str, str]]:
    """(text, label) of at most ``most`` labelled documents, those of the smallest id hashes, with their majority label.

    Reviewers' ``unsure`` and null count for nothing; a tie goes to the
    offensive label, then to the last in order. The share of each label is
    that among all labelled documents: the fit counts on it.
    """
    votes = labels.where(F.col("label").isin(*CLASSES, "none")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    best = F.max_by("label", F.struct("n", F.col("label") != "none", F.col("label")))
    told = votes.groupBy("doc_id").agg(best.alias("label"))
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(few, "doc_id").where("text <> ''").orderBy("doc_id").collect()
    return [(r.text, r.label) for r in rows]


def score_documents(documents: DataFrame, labels: DataFrame, most_labelled: int = 8000, margin: float = 0.95) -> DataFrame:
    """Every document with its scores: doc_id, source, abuse, hate, sexual (best length-normalised log-likelihood
    ratio over its sentences), found array<string> (the categories it is held to have).

    The models are fitted on at most ``most_labelled`` labelled documents, and
    every document is scored. Null and empty texts score -9 and
    have nothing; so has everything where no document is labelled.
    """
    model = fit(labelled(documents, labels, most_labelled))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by most_labelled

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            best, found = [], []
            for t in b.column("text").to_pylist():
                x, f = m.judge(t, margin) if t else ([-9.0] * ORDINARY, set())
                best.append(x), found.append([CLASSES[i] for i in sorted(f)])
            cols = [pa.array([x[i] for x in best], pa.float64()) for i in range(ORDINARY)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *cols, pa.array(found, pa.list_(pa.string()))], ["doc_id", "source", *CLASSES, "found"])

    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
    return rows.mapInArrow(score, "doc_id long, source string, abuse double, hate double, sexual double, found array<string>")


def found_categories(scored: DataFrame) -> DataFrame:
    """(doc_id, category), distinct."""
    return scored.select("doc_id", F.explode("found").alias("category")).distinct()


def source_rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, and of each category the number and the share of the documents that have it."""
    has = [F.count_if(F.array_contains("found", c)).alias(f"n_{c}") for c in CLASSES]
    rates = [F.round(F.col(f"n_{c}") / F.col("documents"), 6).alias(f"rate_{c}") for c in CLASSES]
    return scored.groupBy("source").agg(F.count("*").alias("documents"), *has).select("*", *rates)

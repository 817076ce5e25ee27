"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digits or signs to the letters they stand for, and turns the
text into words with one space before each. Lexicon entries are words (" word ") and stems (" stem", the first letters of a
word), learned from labelled rows with log-odds weights; each word of a text takes the largest weight that matches it,
words within an exception phrase take none, and the sum is normalised by the text's length. Exception phrases are word
pairs that hold an entry but stand in clean texts significantly oftener than in toxic ones, beside any that are given. A
logistic curve over that rate, the sum and the largest weight gives the score.

Nulls and empty texts: a null text scores like an empty one. Labels that are null, or without a document, are not learned
from. A table without both classes, or without rows, gives an empty lexicon and the same prior score for every row. Very
long texts cost time in proportion to their length. Ties: of several labels of one id the largest counts; entries are
ranked by nothing, all significant ones are kept. Repeated rows are scored each. Other columns, whatever their names, are
never read; without_toxic keeps them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_of_hash, stash, text_key

# Look-alike letters (Cyrillic, Greek, full-width signs) and digit or sign substitutions.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTIONS)
ZERO_WIDTH = re.compile("[­​-‍⁠﻿]")
#: Labelled rows of each class that a fit looks at, about: the bound of what is learned from and of what comes to the driver.
SAMPLE_PER_CLASS = 10_000
#: A stem has at least so many letters, and only words of so many at most have stems.
STEM_LEAST, STEM_WORD = 4, 24
#: Entries and exception phrases: standard errors between the classes' shares, and the least log-odds of an entry.
Z_ENTRY, ODDS_ENTRY, Z_EXCEPTION = 5.0, 1.5, 3.0
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """' w1 w2 ... ' of the folded words; ' ' for an empty text."""
    text = (text or "").lower()
    if not text.isascii():
        text = ZERO_WIDTH.sub("", text)
        text = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text) if re.search("[！-～]", text) else text
    words = _WORDS.findall(text.translate(FOLD))
    return f" {' '.join(words)} " if words else " "


def terms(folded: str) -> set[str]:
    """Candidate entries of a text: its words as ' word ' and their stems as ' stem'."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words if len(w) <= STEM_WORD for k in range(STEM_LEAST, len(w))}


@dataclass
class Lexicon:
    """entries: term -> (toxic, clean) numbers of labelled texts that have it."""

    entries: dict[str, tuple[int, int]]
    n_toxic: int
    n_clean: int
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def __setstate__(self, state):
        self.__dict__.update(state, _machine=None)

    def machine(self):
        if self._machine is None:
            a = ahocorasick.Automaton()
            for t, n in self.entries.items():
                a.add_word(t, (len(t), tuple(self.weight(n, label) for label in (None, 0, 1))))
            for p in self.exceptions:
                if (f := fold(p)) != " ":
                    a.add_word(f, (len(f), None))
            a.make_automaton()
            self._machine = a
        return self._machine

    def weight(self, n: tuple[int, int], label: int | None = None) -> float:
        """Log-odds of an entry; label: leave one labelled text of this class out."""
        t, c, nt, nc = max(0, n[0] - (label == 1)), max(0, n[1] - (label == 0)), self.n_toxic - (label == 1), self.n_clean - (label == 0)
        return float(np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1)))

    def matches(self, folded: str, label: int | None = None) -> dict[int, float]:
        """Place of each matched word -> the largest positive weight there; words within an exception phrase are left out.

        Hits come in order of their ends and phrases are merged to disjoint ranges as they come, so time follows the text's length.
        """
        which = 0 if label is None else label + 1
        best: dict[int, float] = {}
        spared: list[list[int]] = []
        for end, (size, w) in self.machine().iter(folded):
            start = end - size + 1
            if w is None:
                while spared and spared[-1][0] >= start:  # a longer phrase with the same end
                    spared.pop()
                if spared and spared[-1][1] >= start:
                    spared[-1][1] = end
                else:
                    spared.append([start, end])
            elif w[which] > best.get(start, 0.0):
                best[start] = w[which]
        if spared:
            lows, highs = [x[0] for x in spared], [x[1] for x in spared]
            best = {s: w for s, w in best.items() if not (k := bisect_right(lows, s)) or highs[k - 1] <= s}
        return best

    def features(self, text: str | None, label: int | None = None) -> tuple[float, float, float]:
        """Rate of weight by length, damped sum, largest weight."""
        if not self.entries:
            return 0.0, 0.0, 0.0
        folded = fold(text)
        best = self.matches(folded, label)
        total = sum(best.values())
        return 100 * total / (folded.count(" ") + 20), float(np.log1p(total)), max(best.values(), default=0.0)

    def score(self, text: str | None) -> float:
        z = self.curve[0] + float(np.dot(self.curve[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id") -> DataFrame:
    """(text, label, frac): about per_class labelled documents of each class, chosen by a hash of the id.

    labels that pass keep are counted over all rows; a class above per_class is thinned to that expected size, so the
    sampled ids, which are broadcast, stay bounded whatever the size of the corpus.
    """
    known = labels.where(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).where("label in (0, 1)").collect()}
    frac = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    pick = F.lit(False)
    for k, f in frac.items():
        pick = pick | ((F.col("label") == k) & share_of_hash(f, F.lit("sample"), "__id"))
    chosen = known.where(pick).groupBy("__id").agg(F.max("label").alias("label"))
    share = F.when(F.col("label") == 1, F.lit(frac.get(1, 1.0))).otherwise(F.lit(frac.get(0, 1.0)))
    return docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(chosen), "__id").select("text", "label", share.alias("frac"))


def _counted(sample: DataFrame, of: Callable[[str], Iterable[str]], nt: int, nc: int) -> DataFrame:
    """(term, t, c, z, odds): of each term that `of` finds in a folded text, the toxic and clean texts of the sample that have it,
    the difference of their shares in standard errors, and the log-odds."""

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label].update(of(fold(text)))
        names = list(seen[0] | seen[1])
        yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([seen[k][x] for x in names], pa.int64()) for k in (1, 0))], names=["term", "t", "c"])

    n = sample.select("text", "label").mapInArrow(run, "term string, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    p = (F.col("t") + F.col("c")) / F.lit(nt + nc)
    z = (F.col("t") / F.lit(nt) - F.col("c") / F.lit(nc)) / F.sqrt(p * (1 - p) * F.lit(1 / nt + 1 / nc) + F.lit(1e-12))
    return n.withColumns({"z": z, "odds": F.log((F.col("t") + 0.5) / F.lit(nt + 1)) - F.log((F.col("c") + 0.5) / F.lit(nc + 1))})


def fit(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = SAMPLE_PER_CLASS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn lexicon, exception phrases and curve from at most about per_class labelled rows of each class (keep: which labels may be used).

    Significance is decided in Spark over all terms of the sample; only significant ones come to the driver. An entry
    needs some 25 toxic texts of 10,000, so their number is bounded by the sample.
    """
    sample = stash(sample_labelled(docs, labels, "toxic", keep, per_class), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        return Lexicon({}, nt, nc, exceptions)
    found = _counted(sample, terms, nt, nc).where((F.col("t") >= 2) & (F.col("z") >= Z_ENTRY) & (F.col("odds") >= ODDS_ENTRY)).collect()
    lex = Lexicon({r["term"]: (r["t"], r["c"]) for r in found}, nt, nc, exceptions)

    def pairs(folded: str) -> set[str]:
        words, at, ends = folded.split(), lex.matches(folded) if lex.entries else {}, -1
        out = set()
        for k, w in enumerate(words):
            ends += 1
            if ends in at:
                out |= {f"{words[k - 1]} {w}"} if k else set()
                out |= {f"{w} {words[k + 1]}"} if k + 1 < len(words) else set()
            ends += len(w)
        return out

    harmless = _counted(sample, pairs, nt, nc).where((F.col("c") >= 5) & (F.col("z") <= -Z_EXCEPTION)).collect()
    lex = Lexicon(lex.entries, nt, nc, (*exceptions, *sorted(r["term"] for r in harmless)))

    def run(batches):
        for b in batches:
            y = b.column(1).to_pylist()
            f = [lex.features(t, k) for t, k in zip(b.column(0).to_pylist(), y, strict=True)]
            yield pa.record_batch([pa.array([x[i] for x in f], pa.float64()) for i in range(3)] + [b.column(1), b.column(2)], names=["a", "b", "c", "label", "frac"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(run, "a double, b double, c double, label int, frac double").collect()], float)
    lex.curve = tuple(logistic(rows[:, :3], rows[:, 3], 1 / rows[:, 4]))
    return lex


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps: (intercept, slopes)."""
    scale = x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), x / scale])
    w = w / w.sum() * len(w)
    beta, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge * 10] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([beta[:1], beta[1:] / scale])


def scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # its entries are bounded by the sample it was learned from

    def run(batches):
        lex = shared.value
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([lex.score(t.as_py()) for t in b.column(2)], pa.float64())], names=["id", "tk", "score"])

    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, tk bigint, score double")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs whose score is under the threshold, all columns kept; scored in place, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    where = docs.columns.index(text_col)

    def run(batches):
        lex = shared.value
        for b in batches:
            yield b.filter(pa.array([lex.score(t.as_py()) < threshold for t in b.column(where)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: compatibility forms, case, look-alike letters of other scripts, digits and signs that stand for letters,
invisible characters; all other punctuation and white space separates words. Lexicon entries are whole words of any length
or beginnings of words (``SHORTEST`` to ``LONGEST`` letters), learned with their log-odds from a bounded sample of labelled rows (``sample_rows``
rows, those least by a hash of the key; whole texts). A phrase of an entry's word and a neighbour that is found in harmless
rows only is an exception: a match within it counts nothing. The weights of a text's matches are summed,
divided by a slowly growing function of its length, and mapped to 0..1 by a logistic curve fitted on the sample.

Null and empty texts have no match and get the score of such texts. With no labelled rows at all, every score is 0.
Ties, repeated rows and further columns of the input don't matter; very long texts are matched whole; an empty table gives an empty
result; labels may repeat (the greatest counts) and may name documents that don't exist; null labels are passed over.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import only, written

#: Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"

_SEPARATORS = [chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in SUBSTITUTES] + list("\u0085   «»‘’“”–—…¿¡")
_TABLE = str.maketrans({**LOOK_ALIKES, **SUBSTITUTES, **dict.fromkeys(INVISIBLE, ""), **dict.fromkeys(_SEPARATORS, " ")})

SHORTEST, LONGEST = 3, 8


def fold(text: str | None) -> str:
    """The text's words, folded, each with a blank before it and the last with one behind it."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {' '.join(text.lower().translate(_TABLE).split())} "


def features(folded: str) -> set[str]:
    """Lexicon entries that a text could give: whole words (`` word ``) and beginnings of words (`` wor``)."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            out.add(f" {word[:n]}")
    return out


@dataclass
class Lexicon:
    """Entries with weights, exception phrases and the logistic curve."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -1e9
    slope: float = 1.0
    _automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """(start, entry) of all matches outside exception phrases; of entries that start together, the weightiest."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry in self.weights:
                self._automaton.add_word(entry, entry)
            self._automaton.make_automaton()
        best: dict[int, str] = {}
        for end, entry in self._automaton.iter(folded):
            start = end - len(entry) + 1
            if start not in best or self.weights[entry] > self.weights[best[start]]:
                best[start] = entry
        if self.exceptions:
            best = {s: e for s, e in best.items() if not any(p in self.exceptions for p in phrases(folded, s))}
        return sorted(best.items())

    def measure(self, folded: str, found: list[tuple[int, str]] | None = None) -> float:
        """The sum of the matches' weights, normalised by length."""
        found = self.matches(folded) if found is None else found
        if not found:
            return 0.0
        words = folded.count(" ") - 1
        return math.fsum(self.weights[e] for _, e in found) / (1.0 + 0.25 * math.log1p(words / 100))

    def score(self, measure: float) -> float:
        x = self.bias + self.slope * measure
        return 0.0 if x < -700 else 1.0 / (1.0 + math.exp(-min(700.0, x)))


def phrases(folded: str, start: int) -> list[str]:
    """The word that starts behind the blank at ``start``, with its neighbour before and behind it."""
    end = folded.find(" ", start + 1)
    out = []
    if start > 0:
        out.append(folded[folded.rfind(" ", 0, start) : end + 1])
    if end + 1 < len(folded):
        out.append(folded[start : folded.find(" ", end + 1) + 1])
    return out


def telling(entries: DataFrame, positive: int, negative: int, n_features: int) -> DataFrame:
    """The entries (entry, toxic, clean) whose odds can't be chance among so many."""
    base = positive / (positive + negative)
    p, n = F.col("toxic") / (F.col("toxic") + F.col("clean")), F.col("toxic") + F.col("clean")
    information = n * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    return entries.filter((F.col("toxic") >= 3) & (p > max(0.6, base)) & (information > math.log(max(2, n_features)) + 2.0))


def choose(found: list[tuple[str, int, int]], positive: int, negative: int) -> dict[str, float]:
    """Entries with their log-odds; of a chain of beginnings the shortest that is as telling."""
    weight = {entry: math.log((a + 0.5) / (positive + 1)) - math.log((b + 0.5) / (negative + 1)) for entry, a, b in found}
    kept: dict[str, float] = {}
    for entry in sorted(weight, key=lambda e: (len(e.rstrip(" ")), e)):
        stem = entry.rstrip(" ")
        shorter = [kept[stem[:n]] for n in range(SHORTEST + 1, len(stem) + 1) if stem[:n] in kept and stem[:n] != entry]
        if not shorter or max(shorter) < weight[entry] - 0.3:
            kept[entry] = weight[entry]
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Bias and slope of a logistic curve, by Newton steps with a little shrinkage of the slope."""
    scale = x.max() if len(x) and x.max() > 0 else 1.0
    design = np.stack([np.ones(len(x)), x / scale], 1)
    beta, ridge = np.zeros(2), np.diag([1e-6, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        beta = np.clip(beta - step, -200, 200)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]) / scale)


def held_out(key: str = "doc_id"):
    return F.coalesce((F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Fit lexicon, exceptions and curve on at most ``sample_rows`` labelled rows that aren't held out."""
    usable = only(labels, key, label).filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(key))
    usable = usable.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = usable.orderBy(F.xxhash64(key), key).limit(sample_rows)
    sample = written(only(docs, key, text).join(F.broadcast(chosen), key).dropDuplicates([key]).select(F.col(text).alias("text"), F.col("_label").alias("label")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y > 0].update(features(fold(t)))
        entries = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(entries), 50_000):
            part = entries[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][e] for e in part], pa.int64()), pa.array([seen[0][e] for e in part], pa.int64())], names=["entry", "toxic", "clean"])

    total = {r["label"] > 0: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = total.get(True, 0), total.get(False, 0)
    if not positive or not negative:
        return Lexicon({}, bias=1e9 if positive else -1e9)
    table = written(sample.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "entries")
    found = telling(table, positive, negative, table.count()).orderBy("entry").collect()  # words of the sample at most
    lexicon = Lexicon(choose([(r["entry"], r["toxic"], r["clean"]) for r in found], positive, negative))
    by_phrase = _phrases(sample, lexicon).groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon.exceptions = {r["phrase"] for r in by_phrase.filter("clean >= 3 and toxic = 0").collect()}
    rows = _measures(sample, lexicon)
    x, y = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows], float)
    lexicon.bias, lexicon.slope = fit_logistic(x, y)
    return lexicon


def _phrases(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(phrase, toxic, clean): in how many of a part's rows of each label a phrase around any match stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                folded = fold(t.as_py())
                seen[y > 0].update({p for s, _ in lexicon.matches(folded) for p in phrases(folded, s)})
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][p] for p in every], pa.int64()), pa.array([seen[0][p] for p in every], pa.int64())], names=["phrase", "toxic", "clean"])

    return sample.mapInArrow(run, "phrase string, toxic long, clean long")


def _measures(sample: DataFrame, lexicon: Lexicon) -> list[tuple[int, float]]:
    """Label and measure of the sample's rows: as many as the sample has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([lexicon.measure(fold(t.as_py())) for t in batch.column(0)], pa.float64())], names=["label", "x"])

    return sorted((int(r["label"] > 0), r["x"]) for r in sample.mapInArrow(run, "label int, x double").collect())


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measure (weights by length), score (0..1) and n_matches of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, numbers = [], []
            for t in batch.column(1):
                folded = fold(t.as_py())
                found = lexicon.matches(folded)
                measures.append(lexicon.measure(folded, found))
                numbers.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(measures, pa.float64()), pa.array([lexicon.score(m) for m in measures], pa.float64()), pa.array(numbers, pa.int32())], names=[key, "measure", "score", "n_matches"])

    rows = only(docs, key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, measure double, score double, n_matches int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(lexicon.measure(fold(t.as_py()))) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

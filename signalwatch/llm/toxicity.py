"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, strips accents, maps look-alike letters of other scripts to Latin ones and digits and marks to the letters they
stand for. The lexicon has whole words and beginnings of words. Lexicon, weights and exceptions are learned from labelled rows, at most SAMPLE a class (by a hash of
the id); two numbers a text (weight of its hits, and that per length) then go through a logistic curve fitted on the same rows.
Whole texts are scored in one pass without any shuffle.

Defined results: null and empty texts have no hits and get the score of none; unlabelled rows and null labels teach nothing; with labels of one kind
only, every score is that kind's share, and without any label every score is 0 (nothing is known to be toxic); repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest

#: Labelled rows a class that the lexicon is learned from.
SAMPLE = 20_000
#: A word or the beginning of words enters the lexicon if the log ratio of its share in toxic rows to that in others is LEAST_WEIGHT at least and, less
#: DEVIATIONS standard errors, still positive; and so many toxic rows have it. No share of all toxic rows is asked for, so a small language's signs enter too.
LEAST_ROWS, LEAST_WEIGHT, DEVIATIONS = 4, 2.5, 3.0
#: Letters that a stem may have, and that a whole word must have.
STEM, LEAST_WORD = range(4, 10), 2
#: Harmless phrases known beforehand; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")

# Letters of Greek and Cyrillic that look like Latin ones, and digits and marks that stand for letters.
_ALIKE = dict(zip("αβεικνορτυχавекмнорстухіјѕԁӏ", "abeiknoptuxabekmhopctyxijsdl", strict=True))
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in (_ALIKE | _STANDS_FOR).items()}
    for code in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        if base.isascii() and base.isalpha():
            table[code] = base
    return table | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)), None)


_FOLD = _table()
_WORD = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, n0, n1): documents of each label with a folded word that begins so; a whole word ends in `$`. Added up by batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(fold(text or "")))
                counts[label].update({w[:k] for w in words for k in STEM if len(w) >= k} | {f"{w}$" for w in words if len(w) >= LEAST_WORD})
            stems = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([c[x] for x in stems], pa.int64()) for c in counts)], ["stem", "n0", "n1"])

    return sample.select("text", "toxic").mapInArrow(run, "stem string, n0 bigint, n1 bigint").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _chosen(found: list[tuple[str, int, float]]) -> dict[str, float]:
    """Of (stem, toxic documents, weight) the longest stems that still hold what their beginnings hold, and none within another."""
    most: dict[str, int] = {}
    for stem, n, _ in found:
        for k in range(STEM[0], len(stem)):
            most[stem[:k]] = max(most.get(stem[:k], 0), n)
    closed = [(s, w) for s, n, w in found if most.get(s, 0) < 0.98 * n]
    out: dict[str, float] = {}
    for stem, weight in sorted(closed, key=lambda x: (len(x[0]), x[0])):
        if not any(stem[:k] in out for k in range(STEM[0], len(stem))):
            out[stem] = weight
    return out


class Lexicon:
    """Words with weights and exception phrases; finds their places in folded text."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()) -> None:
        self.weights, self.exceptions, self._machine = weights, tuple(sorted(set(exceptions))), None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state
        self._machine = None

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for stem in sorted({x.rstrip("$") for x in self.weights}):
                self._machine.add_word(stem, (len(stem), self.weights.get(stem), self.weights.get(f"{stem}$")))
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (len(phrase), None, None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of words that are in the lexicon or begin as a stem of it, outside exception phrases."""
        found, safe = [], []
        if not len(self.machine()):
            return found
        for last, (n, stem, whole) in self.machine().iter(folded):
            start, end = last - n + 1, last + 1
            if start and folded[start - 1 : start].isalpha():
                continue
            ends = not folded[end : end + 1].isalpha()
            if stem is None and whole is None:
                if ends:
                    safe.append((start, end))
            elif stem is not None or ends:
                found.append((start, end, stem if stem is not None else whole))
        return _outside(found, safe) if safe else found


def _outside(found: list[tuple[int, int, float]], safe: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Places that lie in none of the safe ones: of those that begin at or before a place, the one that ends last decides."""
    safe = sorted(safe)
    begins, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))
    return [x for x in found if (k := bisect_right(begins, x[0])) == 0 or reach[k - 1] < x[1]]


def _word_before(folded: str, start: int) -> str:
    """The word that ends one space before a place; empty without one."""
    end = start - 1
    if end < 1 or folded[end] != " ":
        return ""
    at = end
    while at and "a" <= folded[at - 1] <= "z":
        at -= 1
    return folded[at:end]


_AFTER = re.compile(r" ([a-z]+)")


def _features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """[weight of hits, that per hundred words] of each text, both on a log scale."""
    out = np.zeros((len(texts), 2))
    for k, text in enumerate(texts):
        if text:
            found = lexicon.hits(fold(text))
            if found:
                total = sum(x[2] for x in found)
                out[k] = math.log1p(total), math.log1p(100 * total / max(1, len(text.split())))
    return out


def _contexts(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(phrase, toxic): two-word phrases around hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, own = fold(text or ""), set()
                for start, end, _ in lexicon.hits(folded):
                    before, after = _word_before(folded, start), _AFTER.match(folded, end)
                    own |= {f"{before} {folded[start:end]}"} if before else set()
                    own |= {f"{folded[start:end]} {after[1]}"} if after else set()
                phrases += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labels, pa.int32())], ["phrase", "toxic"])

    return sample.select("text", "toxic").mapInArrow(run, "phrase string, toxic int")


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's method with a light ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE) -> DataFrame:
    """(text, label): labelled documents, at most per_class of each label, by a hash of the id. At most 2 * per_class ids are broadcast."""
    modest(docs.sparkSession)
    own = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    part = [own.where(F.col(label) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(part[0].unionByName(part[1])), "doc_id").select("text", label)


def learned(sample: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and curve from (text, toxic 0/1); what comes to the driver is bounded by the sample: words that LEAST_ROWS of its toxic rows have, and phrases with them."""
    sample = sample.persist()
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        sample.unpersist()
        return Lexicon({}), np.array([0.0, 0.0, math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else -30.0])
    weight = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    stems = _stem_counts(sample).where(F.col("n1") >= LEAST_ROWS).withColumn("weight", weight).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("weight") > DEVIATIONS * error))
    lexicon = Lexicon(_chosen([(r["stem"], r["n1"], float(r["weight"])) for r in stems.collect()]), EXCEPTIONS)
    safe = _contexts(sample, lexicon).groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where("n - bad >= 3 and bad < 0.3 * n")
    lexicon = Lexicon(lexicon.weights, (*EXCEPTIONS, *(r["phrase"] for r in safe.collect())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column(0).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["a", "b", "toxic"])

    # equal numbers come together, so only distinct ones reach the driver: 2 * SAMPLE rows at most
    points = sample.select("text", "toxic").mapInArrow(run, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().collect()
    sample.unpersist()
    data = np.array([[r["a"], r["b"], r["toxic"], r["count"]] for r in points])
    data = np.repeat(data, data[:, 3].astype(int), axis=0)
    return lexicon, _logistic(data[:, :2], data[:, 2])


def scored(docs: DataFrame, lexicon: Lexicon, curve: np.ndarray) -> DataFrame:
    """(doc_id, score) of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = _features(some.column(1).to_pylist(), lexicon) @ curve[:2] + curve[2]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")

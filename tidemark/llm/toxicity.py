"""Toxicity classifier with counterfactual regularisation.

A logistic model of the words that a text holds. Words that name groups of people may not move a
score by themselves: each labelled text with such a term is also read with the term swapped for
another of its set, and the squared change of the score is part of the loss. An L1 penalty leaves
weights to few words, so that long texts do not gather noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.decontaminate import BATCH_CHARS, word_hashes
from tidemark.llm.tokenize import slices

# Terms that name groups, in sets whose members can stand for each other.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("man", "woman"), ("men", "women"), ("he", "she"), ("his", "her"), ("boys", "girls"),
    ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish"),
    ("homme", "femme"), ("hommes", "femmes"), ("chrétien", "musulman", "juif"), ("mann", "frau"), ("männer", "frauen"),
    ("christ", "moslem", "jude"), ("hombre", "mujer"), ("hombres", "mujeres"), ("cristiano", "musulmán", "judío"),
)
SIEVE_BITS = 22


def hashes_of(words: list[str]) -> np.ndarray:
    return word_hashes(pa.array([" ".join(words)], pa.string()))[0]


@dataclass(frozen=True)
class Classifier:
    """Hashes of words in ascending order, their weights, and the score's constant part."""

    words: np.ndarray
    weights: np.ndarray
    constant: float

    def scores(self, flat: np.ndarray, at: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        """Of texts given as word hashes in a row and where each text begins; a word counts once in a text."""
        total = np.full(len(at) - 1, self.constant)
        if len(self.words):
            some = np.flatnonzero(sieve[flat >> np.uint64(64 - SIEVE_BITS)])
            place = np.minimum(np.searchsorted(self.words, flat[some]), len(self.words) - 1)
            hit = self.words[place] == flat[some]
            text = np.searchsorted(at, some[hit], "right") - 1
            once = np.unique(text * len(self.words) + place[hit])
            total += np.bincount(once // len(self.words), self.weights[once % len(self.words)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << SIEVE_BITS, bool)
        out[self.words >> np.uint64(64 - SIEVE_BITS)] = True
        return out


class Rows:
    """Sparse rows: the columns of their entries and, unless all are 1, the entries."""

    def __init__(self, rows: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.column = np.concatenate([np.empty(0, np.int64), *rows])
        self.value = np.ones(len(self.column)) if values is None else np.concatenate([np.empty(0), *values])
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.width = width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], len(self.size))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)

    def bound(self, more: int = 0) -> np.ndarray:
        """A diagonal above rows' x rows, for entries of size 1 and so many dense columns besides."""
        return np.bincount(self.column, self.size[self.row] + more, self.width)


def swapped(present: set[int], sets: list[list[int]], turn: int) -> set[int] | None:
    """The text with each identity term replaced by another of its set; None without such a term."""
    out, changed = set(present), False
    for terms in sets:
        for k, term in enumerate(terms):
            if term in present and len(terms) > 1:
                out.discard(term)
                out.add(terms[(k + 1 + turn % (len(terms) - 1)) % len(terms)])
                changed = True
    return out if changed else None


def fit(texts: list[np.ndarray], labels: np.ndarray, l1: float = 3e-5, counterfactual: float = 1.0, least_texts: int = 3, features: int = 5_000, steps: int = 1000, positive_weight: float = 2.0, identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Classifier:
    """texts: word hashes of each labelled text. Accelerated proximal gradient on mean log loss
    (toxic texts weigh `positive_weight` times as much, as they are few) + l1 |w| + counterfactual x mean squared change of the score when identity terms are swapped.

    Features are the words of at least `least_texts` texts whose relation to the label would be a
    matter of chance for less than about one word (a likelihood-ratio bound over all words), at most
    `features` of them, the strongest, and all identity terms. One label only, or no text, gives
    that label's smoothed rate as the score of every text.
    """
    positive = float(labels.sum())
    rate = (positive + 0.5) / (len(labels) + 1)
    if not len(labels) or positive in (0.0, float(len(labels))):
        return Classifier(np.empty(0, np.uint64), np.empty(0), float(np.log(rate / (1 - rate))))
    texts = [np.unique(t) for t in texts]
    words, inverse = np.unique(np.concatenate(texts), return_inverse=True)
    label = np.repeat(labels.astype(float), [len(t) for t in texts])
    n, hits = np.bincount(inverse, minlength=len(words)), np.bincount(inverse, label, len(words))
    share = np.clip(hits / n, 1e-12, 1 - 1e-12)
    strength = n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    strength[(n < least_texts) | (strength < np.log(len(words)))] = -1
    best = np.argsort(-strength, kind="stable")[:features]
    named = np.concatenate([np.empty(0, np.uint64), *(hashes_of(list(s)) for s in identity)])
    chosen = np.union1d(words[best[strength[best] > 0]], named)
    number = {int(h): i for i, h in enumerate(chosen)}
    sets = [[number[int(h)] for h in hashes_of(list(s))] for s in identity]
    present = [np.array(sorted({number[h] for h in t.tolist() if h in number}), np.int64) for t in texts]
    pairs = [(k, other) for k, p in enumerate(present) for turn in range(2) if (other := swapped(set(p.tolist()), sets, turn + k)) is not None]
    x = Rows(present, len(chosen))
    lost = [np.array(sorted(set(present[k].tolist()) - o), np.int64) for k, o in pairs]
    gained = [np.array(sorted(o - set(present[k].tolist())), np.int64) for k, o in pairs]
    swaps = Rows([np.concatenate(z) for z in zip(lost, gained, strict=True)], len(chosen), [np.repeat([1.0, -1.0], [len(u), len(v)]) for u, v in zip(lost, gained, strict=True)])
    w, b, y = np.zeros(len(chosen)), float(np.log(rate / (1 - rate))), labels.astype(float)
    weight = np.where(labels == 1, positive_weight, 1.0)
    weight /= weight.sum()
    ahead, ahead_b, momentum = w, b, 1.0
    # The loss curves less than this diagonal, so each step goes down.
    rate_w = 1 / np.maximum(0.25 * weight.max() * x.bound(1) + 2 * counterfactual / max(1, len(pairs)) * swaps.bound(), 1e-12)
    rate_b = 4 / float(weight.max() * (x.size + 1).sum())
    for _ in range(steps):
        z = x.dot(ahead) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = x.back(error)
        slope += 2 * counterfactual / max(1, len(pairs)) * swaps.back(swaps.dot(ahead))
        new = ahead - rate_w * slope
        new = np.sign(new) * np.maximum(np.abs(new) - rate_w * l1, 0)
        new_b = ahead_b - rate_b * error.sum()
        if ((ahead - new) @ ((new - w) / rate_w)) > 0:
            momentum = 1.0  # start the acceleration anew where it points uphill
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, ahead_b = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    keep = w != 0
    return Classifier(chosen[keep], w[keep], float(b))


def train(docs: DataFrame, labels: DataFrame, learns: Column, most_rows: int = 8_000, **how) -> Classifier:
    """Fits on rows of docs for which `learns` holds and that have one label (toxic 0 or 1).

    The model is fitted on a bounded sample: about `most_rows` labelled rows, chosen by a hash of
    their doc_id, and all of them where there are fewer. Null texts are empty; rows without a
    doc_id or label are not used; a doc_id with both labels is not used.
    """
    common.ship(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("toxic")).where("least = toxic")
    known = known.where(learns).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, most_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", common.text_of().alias("text")).join(known, "doc_id").select("doc_id", "text", "toxic")

    @common.tidy
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), BATCH_CHARS):
                flat, at = word_hashes(texts)
                found = [np.unique(flat[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found, pa.binary()), batch.column(2).slice(first, len(texts))], names=["doc_id", "words", "toxic"])

    got = rows.mapInArrow(words, "doc_id long, words binary, toxic int").orderBy("doc_id", "words").collect()
    return fit([np.frombuffer(r["words"], np.uint64) for r in got], np.array([r["toxic"] for r in got]), **how)


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a text without words has the classifier's constant part."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(classifier)  # at most the features of fit()

    @common.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sieve = model.sieve()
        for batch in batches:
            for first, texts in slices(batch.column(1).fill_null(""), BATCH_CHARS):
                found = model.scores(*word_hashes(texts), sieve)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, holds: int, out_of: int, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; held-out rows are not learnt from."""
    held = lambda c: F.pmod(common.crc_of(c), F.lit(out_of)) == holds
    classifier = train(docs, labels, ~held("doc_id"))
    return scored(docs, classifier).select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"), holds=2, out_of=4)

"""Language identification by a linear-chain conditional random field over words.

Every word has scores for each language, from its affixes and other character n-grams and from the
word itself as a lexicon entry; learned transitions say how readily the language changes from one
word to the next. Forward-backward gives each word's language probabilities, also in texts that mix
languages; a text's language is the one with the largest mean probability.

Training texts have one language each, so chains that change language are made from pieces of
lines of different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.decontaminate import mixed
from tidemark.llm.tokenize import slices

#: Sizes of character n-grams of a word between marks, so that its affixes are among them.
GRAMS = (2, 3, 4)
FACTOR = np.uint64(0xA24BAED4963EE407)
#: Chains end with lines, and within longer lines after so many words.
CHAIN = 256
UNKNOWN = "und"


def features(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words (not empty, lower case) in a row, and where each word's begin, with the end."""
    marked = pc.binary_join_element_wise("\x02", words.cast(pa.string()), "\x03", "").cast(pa.large_binary())
    ends = np.frombuffer(marked.buffers()[1], np.int64, len(marked) + 1, 8 * marked.offset)
    data = np.frombuffer(marked.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    ends = ends - ends[0]
    size = np.diff(ends)
    found, owner = [], []
    gram = data.copy()
    word = np.repeat(np.arange(len(size)), size)
    last = ends[1:][word]
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * FACTOR + data[n - 1 :] if len(gram) > 1 else gram[:0]
        if n in GRAMS:
            inside = np.flatnonzero(np.arange(len(gram)) + n <= last[: len(gram)])
            found.append(mixed(gram[inside], n) >> np.uint64(64 - bits))
            owner.append(word[inside])
    powers = np.cumprod(np.full(int(size.max(initial=1)), FACTOR, np.uint64), dtype=np.uint64)
    whole = np.add.reduceat(data * powers[np.arange(len(data)) - ends[:-1][word]], ends[:-1]) if len(size) else data
    found.append(mixed(whole, 0) >> np.uint64(64 - bits))
    owner.append(np.arange(len(size)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


@dataclass
class Field:
    """Languages, weights by feature and language, log weights of transitions and of a chain's first word."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    bits: int

    def scores(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.empty((0, len(self.languages)))
        ids, at = features(words, self.bits)
        return np.stack([np.add.reduceat(self.weights[:, k][ids], at[:-1]) for k in range(len(self.languages))], axis=1)


@dataclass(frozen=True)
class Chains:
    """Chains of rows, longest first: steps[t] are the rows of all chains that have a word t."""

    steps: list[np.ndarray]

    @classmethod
    def of(cls, begin: np.ndarray, size: np.ndarray) -> Chains:
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        alive = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1))
        return cls([begin[:n] + t for t, n in enumerate(alive.tolist())])

    def marginals(self, scores: np.ndarray, moves: np.ndarray, first: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
        """Forward-backward: each row's probabilities, expected transitions if asked for, and the sum of log partition values."""
        top = scores.max(axis=1, keepdims=True) if len(scores) else scores
        local, step, start = np.exp(scores - top), np.exp(moves), np.exp(first)
        ahead, out = np.empty_like(local), np.empty_like(local)
        log_z = float(top.sum())
        now = None
        for t, rows in enumerate(self.steps):
            now = local[rows] * (start if t == 0 else now[: len(rows)] @ step)
            size = now.sum(axis=1, keepdims=True)
            now /= size
            log_z += float(np.log(size).sum())
            ahead[rows] = now
        expected = np.zeros_like(moves) if counts else None
        back = np.ones((0, len(first)))
        for t in range(len(self.steps) - 1, -1, -1):
            rows = self.steps[t]
            more = np.ones((len(rows), len(first)))
            if len(back):
                after = self.steps[t + 1]
                seen = local[after] * back
                more[: len(after)] = seen @ step.T
                if counts:
                    joint = ahead[rows[: len(after)]]
                    norm = (joint * more[: len(after)]).sum(axis=1)
                    expected += step * ((joint / norm[:, None]).T @ seen)
            both = ahead[rows] * more
            out[rows] = both / both.sum(axis=1, keepdims=True)
            back = more / more.sum(axis=1, keepdims=True)
        return out, expected, log_z


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-case words, and of all words in a row: which, where each text's begin, where each chain begins."""
    lines = pc.split_pattern(pc.utf8_lower(texts), "\n")
    parts = pc.utf8_split_whitespace(lines.flatten())
    words = parts.flatten().dictionary_encode()
    which = words.indices.to_numpy()
    full = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)[which] > 0 if len(which) else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    line = before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    text = line[lines.offsets.to_numpy() - lines.offsets[0].as_py()]
    size = np.diff(line)
    n = -(-size // CHAIN)
    begin = np.repeat(line[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * CHAIN
    return words.dictionary, which[full], text, np.append(begin, line[-1])


def learn(lines: list[str], languages: list[str], labels: list[int], bits: int = 18, steps: int = 60, penalty: float = 1e-6, seed: int = 5) -> Field:
    """Fits the field to lines of known language, and to as many chains of pieces of two or three lines.

    Adam on the mean log likelihood per word with an L2 penalty. Without lines or languages the
    field knows none.
    """
    k = len(languages)
    field = Field(languages, np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k), bits)
    if not k:
        return field
    words, which, text, _ = split_words(pa.array(lines, pa.large_string()))
    rng = np.random.default_rng(seed)
    rows, label, size = [], [], []
    spans = [(int(a), int(b), y) for a, b, y in zip(text, text[1:], labels, strict=False) if b > a]
    if not spans:
        return field

    def put(pieces: list[tuple[int, int, int]]) -> None:
        rows.extend(np.arange(a, b) for a, b, _ in pieces)
        label.extend(np.full(b - a, y) for a, b, y in pieces)
        size.append(sum(b - a for a, b, _ in pieces))

    for i, (a, b, y) in enumerate(spans):
        put([(a, min(b, a + CHAIN), y)])
        pieces = []
        for j in [i, *rng.integers(0, len(spans), int(rng.integers(1, 3)))]:
            a, b, y = spans[j]
            cut = a + int(rng.integers(0, b - a))
            pieces.append((cut, min(b, cut + 12), y))
        put(pieces)
    which, label, size = which[np.concatenate(rows)], np.concatenate(label), np.array(size)
    begin = np.cumsum(size) - size
    chains = Chains.of(begin, size)
    named = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    ids, at = features(words, bits)
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    truth = np.zeros((len(label), k))
    truth[np.arange(len(label)), label] = 1
    inner = np.ones(len(label), bool)
    inner[begin] = False
    here = np.flatnonzero(inner)
    moves = np.zeros((k, k))
    np.add.at(moves, (label[here - 1], label[here]), 1)
    start = truth[begin].sum(axis=0)
    used, ids = np.unique(ids, return_inverse=True)
    value = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    first = [np.zeros_like(v) for v in value]
    second = [np.zeros_like(v) for v in value]
    for turn in range(1, steps + 1):
        score = np.stack([np.bincount(owner, value[0][:, c][ids], len(words)) for c in range(k)], axis=1)
        score[~named] = 0
        seen, expected, _ = chains.marginals(score[which], value[1], value[2], counts=True)
        error = truth - seen
        error[~named[which]] = 0
        by_word = np.stack([np.bincount(which, error[:, c], len(words)) for c in range(k)], axis=1)
        slope = [
            np.stack([np.bincount(ids, by_word[:, c][owner], len(used)) for c in range(k)], axis=1) / len(label) - penalty * value[0],
            (moves - expected) / len(label), (start - seen[begin].sum(axis=0)) / len(label)]
        for v, g, m, s in zip(value, slope, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-9)
    field.weights[used] = value[0]
    field.moves, field.first = value[1], value[2]
    return field


def train(docs: DataFrame, learns: Column, texts: int = 250, lines: int = 8, **how) -> Field:
    """Fits on a bounded sample of the rows that have a doc_id, a text and a language and for which
    `learns` holds: about `texts` texts of each language, chosen by a hash of doc_id, and of each of
    them at most `lines` of its lines, evenly spaced, with their first CHAIN words. All rows are
    used where there are fewer."""
    common.ship(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learns).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return learn([], [], [], **how)
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, texts / n) * (1 << 30)))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < shares[F.col("lang")])
    all_lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    some = F.filter(all_lines, lambda x, i: i % F.ceil(F.size(all_lines) / lines) == 0)
    short = chosen.select("doc_id", "lang", F.posexplode(some).alias("place", "line"))
    short = short.select("doc_id", "lang", "place", F.array_join(F.slice(F.split(F.trim("line"), r"\s+"), 1, CHAIN), " ").alias("line"))
    got = short.orderBy("doc_id", "place", "line", "lang").collect()
    languages = sorted(counts)
    return learn([r["line"] for r in got], languages, [languages.index(r["lang"]) for r in got], **how)


def word_languages(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of all words in a row, which of them have a letter, and where each text's begin, with the end."""
    words, which, text, begin = split_words(texts)
    named = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False) if len(words) else np.empty(0, bool)
    scores = np.zeros((len(words), len(field.languages)))
    scores[named] = field.scores(words.filter(pa.array(named)))
    chains = Chains.of(begin[:-1], np.diff(begin))
    return chains.marginals(scores[which], field.moves, field.first)[0], named[which], text


def predicted(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred and score (its mean probability over words with a letter) of every row.

    A null text, one without a letter, or any text where no language was learnt is UNKNOWN, with
    score 0.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(field)  # 2 ** bits rows of one weight for each language

    @common.tidy
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            for first, texts in slices(batch.column(1).fill_null("")):
                best, mean = np.full(len(texts), len(known.languages)), np.zeros(len(texts))
                if known.languages:
                    chance, named, at = word_languages(known, texts)
                    owner = np.repeat(np.arange(len(texts)), np.diff(at))[named]
                    n = np.bincount(owner, minlength=len(texts))
                    total = np.stack([np.bincount(owner, c, len(texts)) for c in chance[named].T], axis=1) / np.maximum(n, 1)[:, None]
                    best = np.where(n > 0, total.argmax(axis=1), best)
                    mean = np.where(n > 0, np.minimum(total.max(axis=1), 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(names[best], pa.string()), pa.array(mean)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    held = F.pmod(common.crc_of("doc_id"), F.lit(3)) == 1
    return predicted(docs, train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")

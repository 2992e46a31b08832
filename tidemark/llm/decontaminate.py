"""Benchmark passages in documents, also with edits.

Texts become sequences of normalised words. Windows of the size of a benchmark item are turned by
random walks into sequences whose Hamming distance follows the windows' edit distance: a step
writes the word it stands on, and a random bit of that word and step says whether to move on
(Chakraborty, Goldenberg and Koucky's embedding). Several tables sample a few places of a walk; a
window that agrees with an item's window on all places of a table is a candidate. A candidate is
confirmed by the exact edit distance between the item and the words around the window.

An item of n words is entered with windows of a size w for which every run of n words holds a window
on the grid of stride w / 2, from 15 words on two; documents are only read on that grid, items at
every offset. Items with room for one window only are sampled at fewer places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.tokenize import slices
from tidemark.session import materialize

#: Windows have 4, 8 or 16 words, each on a grid of half its size; so items have 5 words at least.
LEAST_WORDS = 5
#: Bytes of words in lower case; zero for bytes between words.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint64)
#: The same words as a pattern, for texts in lower case.
WORD = r"[a-z0-9\x{80}-\x{10ffff}]+"
FACTOR = 0xA24BAED4963EE407
FILTER_BITS = 22
#: Characters hashed together; each takes some tens of bytes for a while.
BATCH_CHARS = 2_000_000
SCHEMA = "doc_id long, item_id long, start long, end long, distance long, item_words long"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the normalised words of all texts in a row, and where each text's begin, with the end.

    A word is a run of ASCII letters and digits, in lower case, and bytes of other UTF-8 characters.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = FOLDED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    place = np.flatnonzero(inside)
    run = np.flatnonzero(first[place])
    length = np.diff(np.append(run, len(place)))
    powers = np.cumprod(np.full(int(length.max()), FACTOR, np.uint64), dtype=np.uint64)
    within = np.arange(len(place)) - np.repeat(run, length)
    return mixed(np.add.reduceat(data[place] * powers[within], run), 0), np.searchsorted(starts, ends)


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """Another well-mixed 64-bit hash of 64-bit hashes."""
    x = values ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Sampling:
    """Random walks and the places that each table samples; the same for items and documents."""

    tables: int
    walks: int
    seed: int = 7

    def symbols(self, words: np.ndarray) -> list[np.ndarray]:
        return [mixed(words, self.seed * 1000 + walk) for walk in range(self.walks)]

    def chosen(self, steps: int, places: int) -> np.ndarray:
        """Places of each table, one in each part of the walk; apart, in longer walks, so that they lie on different words."""
        rng = np.random.default_rng([self.seed, steps])
        edges = np.linspace(0, steps, places + 1).astype(int)
        gap = steps // (2 * places) if steps >= 24 else int(steps >= 12)
        width = np.maximum(1, np.diff(edges) - gap)
        return edges[:-1] + rng.integers(0, width, (self.tables, places))

    def keys(self, symbols: list[np.ndarray], starts: np.ndarray, size: int, places: int) -> Iterator[np.ndarray]:
        """By table, the key of each window; windows begin at starts and hold `size` words."""
        chosen = self.chosen(size * 3 // 2, places)
        last = starts + size - 1
        for walk, symbol in enumerate(symbols):
            own = [t for t in range(self.tables) if t % self.walks == walk]
            wanted = {int(p) for t in own for p in chosen[t]}
            written: dict[int, np.ndarray] = {}
            at = starts
            for step in range(max(wanted, default=-1) + 1):
                if step and step % 32 == 0:
                    symbol = mixed(symbol, step)
                here = symbol[at]
                if step in wanted:
                    written[step] = here
                at = np.minimum(at + ((here >> np.uint64(step % 32)) & np.uint64(1)).view(np.int64), last)
            for t in own:
                key = written[int(chosen[t][0])] ^ np.uint64((t * 0x9E3779B97F4A7C15 + 8 * size + places) % 2**64)
                for p in chosen[t][1:].tolist():
                    key = key * np.uint64(0xD6E8FEB86659FD93) + written[p]
                key = key * np.uint64(0xD6E8FEB86659FD93)
                yield key ^ (key >> np.uint64(32))


def window_size(n: int) -> int:
    """16 from 39 words on, 8 from 11, 4 below: wider ones lose copies with 20 % edits."""
    return 16 if n >= 39 else 8 if n >= 11 else 4


def window_of(n: int) -> tuple[int, int]:
    """Window size and sampled places for an item of n words: three where a run of n words may hold one window of the grid only, else four."""
    w = window_size(n)
    return w, 3 if n < 2 * w - 1 else 4


@dataclass(frozen=True)
class Index:
    """Items of one block: their words, and all keys with the item and offset they stand for."""

    item_ids: list[int]
    words: list[np.ndarray]
    windows: list[tuple[int, int]]
    keys: np.ndarray
    entries: np.ndarray
    sieve: np.ndarray


def build_index(item_ids: list[int], texts: list[str], sampling: Sampling) -> Index:
    flat, at = word_hashes(pa.array(texts, pa.string()))
    words = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    keep = [i for i, w in enumerate(words) if len(w) >= LEAST_WORDS]
    item_ids, words = [item_ids[i] for i in keep], [words[i] for i in keep]
    keys, entries = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int64)]
    for i, w in enumerate(words):
        size, places = window_of(len(w))
        starts = np.arange(len(w) - size + 1)
        for key in sampling.keys(sampling.symbols(w), starts, size, places):
            keys.append(key)
            entries.append(np.stack([np.full(len(starts), i), starts], axis=1))
    key, entry = np.concatenate(keys), np.concatenate(entries)
    order = np.argsort(key, kind="stable")
    sieve = np.zeros(1 << FILTER_BITS, bool)
    sieve[key >> np.uint64(64 - FILTER_BITS)] = True
    return Index(item_ids, words, sorted({window_of(len(w)) for w in words}), key[order], entry[order], sieve)


def edit_match(item: np.ndarray, words: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the run of words closest to the item, if within `most` edits.

    Exact: every run of words may match; ties go to the first end, then the shortest run.
    """
    if np.isin(item, words).sum() < len(item) - most:
        return None
    m = len(words)
    big = np.int64(m + 1)  # distance and start in one number: less is closer, then later in start
    column = np.arange(m + 1)
    row = np.int64(0) * big + (m - column)
    for k, x in enumerate(item.tolist(), 1):
        new = np.empty(m + 1, np.int64)
        new[0] = k * big + m
        new[1:] = np.minimum(row[:-1] + big * (words != np.uint64(x)), row[1:] + big)
        row = np.minimum.accumulate(new - column * big) + column * big
    best = int(np.argmin(row // big))
    distance = int(row[best] // big)
    return (distance, m - int(row[best] % big), best) if distance <= most else None


def matches(index: Index, sampling: Sampling, words: np.ndarray, at: np.ndarray, share: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, start, end, distance, item words) of the best match of each text and item."""
    size_of, symbols = np.diff(at), sampling.symbols(words)
    found: set[tuple[int, int, int]] = set()
    for size, places in index.windows:
        stride = size // 2
        n = np.maximum((size_of - size) // stride + 1, 0) * (size_of >= size)
        text = np.repeat(np.arange(len(n)), n)
        starts = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
        for key in sampling.keys(symbols, starts, size, places):
            some = np.flatnonzero(index.sieve[key >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(index.keys, key[some], "left"), np.searchsorted(index.keys, key[some], "right")
            for w, a, b in zip(some[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                for item, offset in index.entries[a:b].tolist():
                    found.add((int(text[w]), item, int(starts[w]) - offset))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, begin in sorted(found):
        own = index.words[item]
        most = int(share * len(own))
        a, b = max(int(at[text]), begin - most), min(int(at[text + 1]), begin + len(own) + most)
        seen = best.get((text, item))
        if seen and seen[0] == 0:
            continue
        if match := edit_match(own, words[a:b], most):
            new = (match[0], match[1] + a - int(at[text]), match[2] + a - int(at[text]))
            best[text, item] = min(seen, new) if seen else new
    for (text, item), (distance, start, end) in best.items():
        yield text, item, start, end, distance, len(index.words[item])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, tables: int = 24, walks: int = 8, block_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, start, end (words), distance (edits in words) and item_words.

    One row for each document and benchmark item that some run of the document's words matches
    within (1 - similarity) x item words edits, at its best match. With the default tables and walks
    97 % of copies at 20 % edits are candidates or more, as measured at the shortest items of each window
    size (96.7 % if all edits are deletions); a lower similarity needs more. Null texts have no words; items of fewer than
    LEAST_WORDS words (short_items() lists them, short_matches() finds them), or without an item_id, are not looked for; documents without a doc_id are
    reported with a null. Rows that repeat an id count as one. Empty tables give no rows.

    Items come to the tasks in blocks of at most `block_items`, so that an index has a bounded size;
    each block reads the documents once.
    """
    sampling = Sampling(tables, walks)
    spark, share = docs.sparkSession, 1 - similarity + 1e-9
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text")).distinct()
    blocks = max(1, math.ceil(items.count() / block_items))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(build_index([r["item_id"] for r in part], [r["text"] for r in part], sampling))

        @common.tidy
        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                for first, texts in slices(batch.column(1).fill_null(""), BATCH_CHARS):
                    words, at = word_hashes(texts)
                    hits = list(matches(known, sampling, words, at, share))
                    if hits:
                        text, item, start, end, distance, n = zip(*hits, strict=True)
                        doc_ids = batch.column(0).take(pa.array([first + t for t in text]))
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids, pa.array([known.item_ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, end, distance, n))],
                            names=["doc_id", "item_id", "start", "end", "distance", "item_words"])

        found = rows.mapInArrow(scan, SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("distance", "start", "end", "item_words")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.start", "x.end", "x.distance", "x.item_words")


def short_items(benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Items (item_id, words) that contaminated() does not look for: they have fewer words than a window needs.
    A passage of so few words says little; whoever wants them found takes short_matches()."""
    lower = F.translate(common.text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select("item_id", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    return rows.where(F.size("words") < least)


def short_matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Documents that hold a short item word for word, in the columns of contaminated(), at its first place.

    20 % of so few words is no edit, so runs of words are compared as they are: runs of the lengths that
    short items have meet the items by equality. Items without a word are in no document.
    """
    items = short_items(benchmark, least).where("item_id IS NOT NULL AND size(words) > 0").distinct()
    items = materialize(items.select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("run")), "short-items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # less than `least` numbers
    lower = F.translate(common.text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))

    def runs_of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), lambda i: i + n <= F.size("words"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("run"), i.alias("start")))

    empty = F.array().cast("array<struct<n:int,run:string,start:int>>")
    found = rows.select("doc_id", F.explode(F.concat(empty, *(runs_of(n) for n in lengths))).alias("r")).select("doc_id", "r.*").join(items, ["n", "run"])
    return found.groupBy("doc_id", "item_id").agg(F.min("start").cast("long").alias("start"), F.max("n").cast("long").alias("item_words")).select(
        "doc_id", "item_id", "start", (F.col("start") + F.col("item_words")).alias("end"), F.lit(0).cast("long").alias("distance"), "item_words")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs less those that hold a benchmark item; rows without a doc_id stay."""
    found = materialize(contaminated(docs, benchmark, **how).where("doc_id is not null").select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op7_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))

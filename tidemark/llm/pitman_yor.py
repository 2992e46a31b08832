"""Hierarchical Pitman-Yor language model, trained and applied over a whole corpus.

A word's probability in a context comes from a restaurant whose customers are the word's training
tokens after that context; each table that they open sends a customer to the parent restaurant,
which all contexts share, and whose own tables draw from a uniform base over the known words and one
unknown. A context is the word before, by its 64-bit hash, or the start of a text; there are as many
restaurants as the corpus has words.

Given the parent's probabilities, the tables of one word in one restaurant are independent of other
words, so Gibbs sampling runs word by word: a sweep draws every restaurant's number of tables from
its exact conditional distribution (generalised Stirling numbers), then the parent's. What words
share are customers and tables per context. After each sweep a bucket sends those of its own words,
by ranges of the context's hash; a range adds up what the buckets sent and tells each bucket the sums
of the contexts it asked for. A context of any frequency is one entry per bucket there, so a hot one
needs no salt, and the driver only sees four sums over the corpus. Seats are written after every
sweep, and draws are seeded by sweep and bucket, so a repeated task gives the same result. Predictive
probabilities are averaged over sweeps; the tables that they follow from are kept, not they.

Data move as follows. Each task counts the distinct (word, context) pairs of a batch of documents
and sends the counts to buckets by ranges of the word's hash; a word of any frequency sends at most
one entry per context and batch. A bucket answers each batch with the pairs' probabilities and the
words' counts, and the batch adds them up by document.

On disk lie the buckets' pairs and the texts' tokens, once, and two states of the seats, of which a
sweep overwrites the older. Shuffle files go when the step that made them has written its result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import common
from tidemark.llm.tokenize import slices
from tidemark.session import materialize, shared_folder, shuffles_released

#: Stands for the end of a text among the hashes of words.
END = xxh64_intdigest(b"\x00end of text")
#: Up to so many customers, Stirling numbers come from a table; beyond, from contour integrals.
EXACT = 64
#: Nodes of a contour above the real axis, Metropolis steps of a draw, and draws made together.
NODES, MOVES, AT_ONCE = 24, 16, 10_000
BATCH_CHARS = 12_000_000


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; equal bytes of the elements stand together."""
    out = [struct.pack("<I", len(arrays))]
    for x in arrays:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
        body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [struct.pack("<4sQQ", x.dtype.str.encode(), len(x), len(body)), body]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        at += 20
        kind = np.dtype(kind.rstrip(b"\x00").decode())
        planes = pa.decompress(data[at : at + size], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


@dataclass(frozen=True)
class Model:
    """Discounts and strengths of the context restaurants and of their parent; sweeps, and how many
    of them at the end are averaged. Contexts are words; a caller may have that many hash classes of
    them instead (the start of a text is one more)."""

    discount: float = 0.8
    strength: float = 1.0
    parent_discount: float = 0.7
    parent_strength: float = 10.0
    classes: int | None = None
    sweeps: int = 4
    averaged: int = 2
    seed: int = 11


def batch_pairs(texts: pa.Array, train: np.ndarray, classes: int | None) -> tuple[np.ndarray, ...]:
    """For a batch of texts: words' hashes (ascending), pairs per word, pairs' contexts (the hash of the
    word before, END's for the first; or classes) and training counts; then tokens per text and, by text and in ascending order, the tokens' pairs."""
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten().dictionary_encode()
    # Words are lowered, not texts: ascii_lower breaks the offsets of a slice that was cast.
    hashes = np.fromiter(map(xxh64_intdigest, pc.ascii_lower(words.dictionary).to_pylist()), np.uint64, len(words.dictionary))
    hashes = np.append(hashes, np.uint64(END))
    which = words.indices.to_numpy()
    full = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)[which] > 0 if len(which) else np.empty(0, bool)
    at = np.concatenate([[0], np.cumsum(full)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    token = np.insert(which[full], at[1:], len(hashes) - 1)
    sizes = np.diff(at) + 1
    first = np.cumsum(sizes) - sizes
    distinct, rank = np.unique(hashes, return_inverse=True)
    rank = rank[token]
    context, names = np.empty(len(token), np.int64), distinct
    context[1:] = rank[:-1]
    if classes is not None:
        names = np.arange(classes + 1, dtype=np.uint64)
        context[1:] = (distinct[rank[:-1]] >> np.uint64(20)) % np.uint64(classes)
    context[first] = np.searchsorted(distinct, np.uint64(END)) if classes is None else classes
    pairs, inverse = np.unique(rank * len(names) + context, return_inverse=True)
    count = np.bincount(inverse, weights=np.repeat(train, sizes), minlength=len(pairs)).astype("<u8")
    used, per_word = np.unique(pairs // len(names), return_counts=True)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ordered = np.sort(text * len(pairs) + inverse) - text * len(pairs)
    return distinct[used], per_word.astype("<u4"), names[pairs % len(names)], count, sizes.astype("<u4"), ordered.astype("<u4")


def range_edges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of equal ranges of ascending hashes begins, with the end."""
    cuts = (np.arange(1, ranges) * (2**64 // ranges)).astype(np.uint64) if ranges > 1 else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])


def count_pairs(docs: DataFrame, holds: int, out_of: int, buckets: int, classes: int | None) -> DataFrame:
    """Rows (bucket, batch, pairs) and, with a null bucket, (batch, tokens)."""

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("pairs", pa.binary()), ("tokens", pa.binary())])
        for batch in batches:
            for start, texts in slices(batch.column(1).fill_null(""), BATCH_CHARS):
                doc_ids, crc = batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)).to_numpy()
                held = crc % out_of == holds
                words, per_word, context, counts, sizes, tokens = batch_pairs(texts, (~held).astype(float), classes)
                edge = range_edges(words, buckets)
                place = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])[edge]
                for b in range(buckets):
                    w, p = slice(edge[b], edge[b + 1]), slice(place[b], place[b + 1])
                    if edge[b] < edge[b + 1]:
                        names, which = np.unique(context[p], return_inverse=True)
                        data = packed(words[w], per_word[w], names, which.astype("<u4"), counts[p])
                        yield pa.RecordBatch.from_pylist([{"bucket": b, "batch": number, "pairs": data}], schema)
                step = np.diff(tokens, prepend=np.uint32(0))  # wraps round where a text begins, and back
                data = packed(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8), held.view(np.uint8), sizes, step)
                yield pa.RecordBatch.from_pylist([{"batch": number, "tokens": data}], schema)
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.crc_of("doc_id").alias("crc"))
    return rows.mapInArrow(count, "bucket int, batch long, pairs binary, tokens binary")


def dealt_out(rows: DataFrame, key: str, *order) -> DataFrame:
    """Rows by `key`, one key after another in a task, in `order`; rows without a key by batch."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.col(key) if "batch" not in rows.columns else F.coalesce(key, F.hash("batch"))
    return rows.repartitionById(n, F.pmod(place, F.lit(n)).cast("int")).sortWithinPartitions(key, *order)


def merge_buckets(counted: DataFrame) -> DataFrame:
    """A row per bucket with its restaurants (model), and for each batch which pairs it asks for (request); the rows
    of tokens as they are. In the shared folder; the pairs are only shuffled."""
    kinds = {"bucket": pa.int32(), "batch": pa.int64(), "model": pa.binary(), "request": pa.binary(), "tokens": pa.binary()}

    def merged(bucket: int, batches: list[int], parts: list[list[np.ndarray]]) -> Iterator[dict]:
        words, rank = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        rank = np.repeat(rank, np.concatenate([p[1] for p in parts]))
        names, context = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        begin = np.cumsum([0, *(len(p[2]) for p in parts)])
        context = context[np.concatenate([p[3] + a for p, a in zip(parts, begin, strict=False)])]
        pairs, inverse = np.unique(rank * len(names) + context, return_inverse=True)
        counts = np.zeros(len(pairs), np.uint64)
        np.add.at(counts, inverse, np.concatenate([p[4] for p in parts]))
        per_word = np.bincount(pairs // len(names), minlength=len(words)).astype("<u4")
        yield {"bucket": bucket, "model": packed(per_word, (pairs % len(names)).astype("<u4"), counts, names)}
        cuts = np.cumsum([0, *(len(p[3]) for p in parts)])
        for batch, a, b in zip(batches, cuts, cuts[1:], strict=False):
            yield {"bucket": bucket, "batch": batch, "request": packed(np.diff(inverse[a:b], prepend=0).astype("<u4"))}

    @common.tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(kinds)
        now, ids, parts = None, [], []
        for batch in batches:
            for bucket, number, data, tokens in zip(*batch.columns, strict=True):
                if not bucket.is_valid:
                    yield pa.RecordBatch.from_pylist([{"batch": number.as_py(), "tokens": tokens.as_py()}], schema)
                    continue
                if bucket.as_py() != now and parts:
                    for row in merged(now, ids, parts):
                        yield pa.RecordBatch.from_pylist([row], schema)
                    ids, parts = [], []
                now = bucket.as_py()
                ids.append(number.as_py())
                parts.append(unpacked(data.as_py()))
        if parts:
            for row in merged(now, ids, parts):
                yield pa.RecordBatch.from_pylist([row], schema)

    return materialize(dealt_out(counted, "bucket", "batch").mapInArrow(merge, "bucket int, batch long, model binary, request binary, tokens binary"), "pitman-yor-buckets")


def log_stirling(most: int, discount: float) -> np.ndarray:
    """log of generalised Stirling numbers [customers, tables] up to `most` customers."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - tables * discount, 0)) + out[c, 1:]
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series above 8."""
    low = np.zeros(np.shape(x))
    x = np.asarray(x, float) + 0.0
    for _ in range(8):
        small = x < 8
        low -= np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = x + small
    y = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def draw_many(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables by the same distribution as below EXACT, S(customers, t) * weight ** t, for any customers.

    S(n, t) is n! / (t! d^t) times the coefficient of x^n in (1 - (1 - x)^d)^t, so t is Poisson with
    mean weight / d, given that t draws of the power series sum to n. The coefficient is a contour
    integral through the saddle point: a circle round 0, or a parabola round the cut from 1 on where
    the saddle is close to the cut; the trapezoid rule is as good as exact on either. Metropolis steps
    with independent binomial proposals, MOVES of them, do the draw.
    """
    n, d, rate = customers.astype(float), discount, weight / discount
    low, high = np.full(len(n), -1500.0), np.full(len(n), 1500.0)
    for _ in range(64):  # the saddle x = 1 - z, by its logit: n = weight * x * z ** (d - 1)
        v = (low + high) / 2
        less = np.log(weight) - np.logaddexp(0, -v) + (1 - d) * np.logaddexp(0, v) < np.log(n)
        low, high = np.where(less, v, low), np.where(less, high, v)
    x, log_z = np.exp(-np.logaddexp(0, -low)), -np.logaddexp(0, low)
    mean = np.minimum(-np.expm1(d * log_z) * rate, n)
    z = np.maximum(np.exp(log_z), 2 / n)
    circle = z >= 0.25
    at = np.arange(NODES + 1)

    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        f, slope, bend = -np.expm1(d * log_z), d * np.exp((d - 1) * log_z) * x, d * (1 - d) * np.exp((d - 2) * log_z) * x * x
        spread = mean * ((slope + bend) / f - (slope / f) ** 2)
        turn = np.minimum(np.pi / NODES, 0.5 / np.sqrt(np.maximum(spread, 1e-9)))[:, None] * at
        round0 = np.log(x)[:, None] + 1j * turn
        on_circle = np.log(-np.expm1(d * np.log1p(-np.exp(round0)))), -n[:, None] * round0

        zd, z0 = z**d, np.minimum(z, 0.25)
        g1 = (n + 1) / (1 - z0) - d * mean * zd / z0 / (1 - zd)
        g2 = (n + 1) / (1 - z0) ** 2 + d * mean * zd / z0**2 * ((1 - d) * (1 - zd) - d * zd) / (1 - zd) ** 2
        spread = np.maximum(4 * z0 * z0 * g2 + 2 * z0 * g1, 1.0)
        u = 1 + 1j * np.minimum(0.28, 0.5 / np.sqrt(spread))[:, None] * at
        log_cut = np.log(z0)[:, None] + 2 * np.log(u)
        on_cut = np.log1p(-np.exp(d * log_cut)), np.log(u) - (n + 1)[:, None] * np.log1p(-np.exp(log_cut))
    per_table, rest = (np.where(circle[:, None], a, b) for a, b in zip(on_circle, on_cut, strict=True))
    half = np.where((at == 0) | (at == NODES), 0.5, 1.0)

    chance = np.clip(mean / n, 1e-300, 1 - 1e-16)

    def propose() -> tuple[np.ndarray, np.ndarray]:
        t = 1 + rng.binomial(customers - 1, chance)
        logs = t[:, None] * per_table + rest
        top = logs[:, :1].real
        sums = (np.exp(logs - top) * half).real.sum(axis=1)
        with np.errstate(divide="ignore"):
            target = np.log(np.maximum(sums, 0)) + top[:, 0] + t * np.log(rate) - log_gamma(t + 1)
        own = -log_gamma(t) - log_gamma(n - t + 1) + (t - 1) * np.log(chance) + (n - t) * np.log1p(-chance)
        return t, target - own

    tables, score = propose()
    for _ in range(MOVES):
        t, new = propose()
        with np.errstate(invalid="ignore"):
            take = (np.log(rng.random(len(n))) < new - score) | np.isneginf(score)
        tables, score = np.where(take, t, tables), np.where(take, new, score)
    return tables


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of one dish in each restaurant, given its customers and the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    first = customers[some]
    order = np.argsort(first, kind="stable")
    some, first = some[order], first[order]
    cuts = np.searchsorted(first, np.arange(EXACT + 2))
    for c in range(2, EXACT + 1):
        rows = some[cuts[c] : cuts[c + 1]]
        if len(rows):
            logs = stirling[c, 1 : c + 1] + np.log(weight[rows])[:, None] * np.arange(1, c + 1)
            chance = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + (chance < (rng.random(len(rows)) * chance[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    for rows in np.split(many, range(AT_ONCE, len(many), AT_ONCE)):
        if len(rows):
            tables[rows] = draw_many(customers[rows].astype(np.int64), weight[rows], discount, rng)
    return tables


@dataclass(frozen=True)
class Totals:
    """Sums over all words: customers and tables by context, for the contexts of one bucket; customers
    and tables of the parent; training tokens and known words."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: int
    parent_tables: int
    tokens: int
    known: int


class Restaurants:
    """One bucket's seats. `names` are the hashes of its contexts, ascending; `kept` has the states before
    the last whose predictive probabilities are averaged: tables, the parent's tables and the totals of each."""

    def __init__(self, data: bytes, bucket: int, model: Model, state: bytes | None = None):
        per_word, context, counts, *names = unpacked(data)
        self.names, self.per_word = names[0] if names else np.empty(0, np.uint64), per_word
        self.model, self.bucket = model, bucket
        self.word = np.repeat(np.arange(len(per_word)), per_word)
        self.begin = np.cumsum(per_word, dtype=np.int64) - per_word
        self.context, self.counts = context.astype(np.int64), counts.astype(np.int64)
        self.word_counts = np.add.reduceat(self.counts, self.begin) if len(self.begin) else np.empty(0, np.int64)
        rest = [x.astype(np.int64) for x in unpacked(state)] if state is not None else []
        self.tables = rest[0] if rest else np.minimum(self.counts, 1)  # one table each, before the first sweep
        self.up()
        self.parent_tables = rest[1] if rest else np.minimum(self.parent_customers, 1)
        self.kept = [(rest[i], rest[i + 1], Totals(rest[i + 2], rest[i + 3], *rest[i + 4].tolist())) for i in range(2, len(rest), 5)]
        self.stirling = log_stirling(EXACT, model.discount), log_stirling(EXACT, model.parent_discount)

    def packed(self) -> bytes:
        """The state of the seats, without what no sweep changes."""
        sums = lambda x: np.array([x.parent_customers, x.parent_tables, x.tokens, x.known])
        kept = (x for tables, parent_tables, totals in self.kept for x in (tables, parent_tables, totals.customers, totals.tables, sums(totals)))
        return packed(*(x.astype("<u8") for x in (self.tables, self.parent_tables, *kept)))

    def up(self) -> None:
        self.parent_customers = np.add.reduceat(self.tables, self.begin) if len(self.begin) else np.empty(0, np.int64)

    def parent(self, totals: Totals) -> np.ndarray:
        m = self.model
        new = (m.parent_strength + m.parent_discount * totals.parent_tables) / (totals.known + 1)
        return (self.parent_customers - m.parent_discount * self.parent_tables + new) / (m.parent_strength + totals.parent_customers)

    def predictive(self, totals: Totals) -> np.ndarray:
        m = self.model
        new = (m.strength + m.discount * totals.tables)[self.context] * self.parent(totals)[self.word]
        return (self.counts - m.discount * self.tables + new) / (m.strength + totals.customers)[self.context]

    def keep(self, turn: int, totals: Totals) -> None:
        """Keeps the state after `turn` sweeps, if it is one of the last."""
        if turn > self.model.sweeps - self.model.averaged:
            self.kept.append((self.tables, self.parent_tables, totals))

    def mean(self) -> np.ndarray:
        """The mean of the kept states' predictive probabilities; the seats are those of the last one then."""
        mean = np.zeros(len(self.counts))
        for self.tables, self.parent_tables, totals in self.kept:
            self.up()
            mean = self.predictive(totals) / self.model.averaged + mean
        return mean

    def sweep(self, turn: int, totals: Totals) -> None:
        """New seats, given the totals that the sweep before has left."""
        m, rng = self.model, np.random.default_rng([self.model.seed, turn, self.bucket])
        weight = (m.strength + m.discount * totals.tables)[self.context] * self.parent(totals)[self.word]
        self.tables = draw_tables(self.counts, weight, m.discount, self.stirling[0], rng)
        self.up()
        new = np.full(len(self.parent_customers), (m.parent_strength + m.parent_discount * totals.parent_tables) / (totals.known + 1))
        self.parent_tables = draw_tables(self.parent_customers, new, m.parent_discount, self.stirling[1], rng)


SEATS = "bucket int, part int, data binary, parent_customers long, parent_tables long, tokens long, known long"


def seats_rows(seats: Restaurants, ranges: int) -> Iterator[pa.RecordBatch]:
    """A bucket's seats, with its sums over words (part null), and for each range of contexts what the
    bucket has of them: hashes, customers and tables."""
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SEATS.split(", ")])
    yield pa.RecordBatch.from_pylist([{
        "bucket": seats.bucket, "data": seats.packed(), "parent_customers": int(seats.parent_customers.sum()), "parent_tables": int(seats.parent_tables.sum()),
        "tokens": int(seats.counts.sum()), "known": int((seats.word_counts > 0).sum())}], schema)
    customers, tables = np.zeros(len(seats.names), np.int64), np.zeros(len(seats.names), np.int64)
    np.add.at(customers, seats.context, seats.counts)
    np.add.at(tables, seats.context, seats.tables)
    edge = range_edges(seats.names, ranges)
    for part, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
        if a < b:
            yield pa.RecordBatch.from_pylist([{"bucket": seats.bucket, "part": part, "data": packed(seats.names[a:b], customers[a:b], tables[a:b])}], schema)


def context_sums(seats: DataFrame) -> DataFrame:
    """(bucket, part, data): customers and tables of the contexts that a bucket asked a range for, over all buckets."""

    def replies(part: int, asked: list[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        names, which = np.unique(np.concatenate([x[0] for _, x in asked]), return_inverse=True)
        customers, tables = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        np.add.at(customers, which, np.concatenate([x[1] for _, x in asked]))
        np.add.at(tables, which, np.concatenate([x[2] for _, x in asked]))
        cuts = np.cumsum([0, *(len(x[0]) for _, x in asked)])
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
        for (bucket, _), a, b in zip(asked, cuts, cuts[1:], strict=False):
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "part": part, "data": packed(customers[which[a:b]], tables[which[a:b]])}], schema)

    @common.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for bucket, part, data in zip(*batch.columns, strict=True):
                if part.as_py() != now and asked:
                    yield from replies(now, asked)
                    asked = []
                now = part.as_py()
                asked.append((bucket.as_py(), unpacked(data.as_py())))
        if asked:
            yield from replies(now, asked)

    rows = seats.where("part is not null").select("bucket", "part", "data")
    return dealt_out(rows, "part", "bucket").mapInArrow(add, "bucket int, part int, data binary")


def written(seats: DataFrame, folder: str) -> DataFrame:
    """SEATS in a folder, instead of an older state there."""
    seats.write.mode("overwrite").parquet(folder)
    return seats.sparkSession.read.schema(seats.schema).parquet(folder)


def seated(merged: DataFrame, model: Model, ranges: int) -> DataFrame:
    """SEATS before the first sweep."""

    @common.tidy
    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(*batch.columns, strict=True):
                yield from seats_rows(Restaurants(data.as_py(), bucket.as_py(), model), ranges)

    return merged.where("model is not null").select("bucket", "model").mapInArrow(begin, SEATS)


def corpus_sums(seats: DataFrame) -> tuple[int, int, int, int]:
    row = seats.where("part is null").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("parent_customers", "parent_tables", "tokens", "known"))).first()
    return tuple(int(x) for x in row)


def with_sums(seats: DataFrame, merged: DataFrame, requests: bool = False) -> DataFrame:
    """(bucket, part, batch, data), a bucket's rows together: its pairs, its seats, the sums of its contexts, and requests."""
    none, columns = F.lit(None).cast("long").alias("batch"), ("bucket", "part", "batch", "data")
    both = merged.where("model is not null").select("bucket", F.lit(-2).alias("part"), none, F.col("model").alias("data"))
    both = both.unionByName(seats.where("part is null").select("bucket", F.lit(-1).alias("part"), none, "data"))
    both = both.unionByName(context_sums(seats).select("bucket", "part", none, "data"))
    if requests:
        asked = merged.where("request is not null")
        both = both.unionByName(asked.select("bucket", F.lit(2**31 - 1).alias("part"), "batch", F.col("request").alias("data")))
    return dealt_out(both.select(*columns), "bucket", "part", "batch")


def read_seats(batches: Iterator[pa.RecordBatch], model: Model, sums: tuple[int, int, int, int]) -> Iterator[tuple[Restaurants, Totals, Iterator[tuple[int, bytes]]]]:
    """Each bucket of with_sums: its seats, the totals, and its requests as (batch, data)."""
    rows = ((b.as_py(), p.as_py(), n.as_py(), d.as_py()) for batch in batches for b, p, n, d in zip(*batch.columns, strict=True))
    for bucket, own in groupby(rows, key=lambda r: r[0]):
        seats, row = Restaurants(next(own)[3], bucket, model, next(own)[3]), None
        parts: list[list[np.ndarray]] = []
        for row in own:
            if row[2] is not None:
                break
            parts.append(unpacked(row[3]))
        customers, tables = (np.concatenate(x) for x in zip(*parts, strict=True))
        assert len(customers) == len(seats.names)
        asked = ((r[2], r[3]) for r in chain([row], own)) if row and row[2] is not None else iter(())
        yield seats, Totals(customers, tables, *sums), asked


def swept(seats: DataFrame, merged: DataFrame, model: Model, turn: int, ranges: int) -> DataFrame:
    """SEATS after one more sweep; the state before it counts for the mean if it is one of the last."""
    sums = corpus_sums(seats)

    @common.tidy
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, totals, _ in read_seats(batches, model, sums):
            own.keep(turn, totals)
            own.sweep(turn, totals)
            yield from seats_rows(own, ranges)

    return with_sums(seats, merged).mapInArrow(sweep, SEATS)


def answers(seats: DataFrame, merged: DataFrame, model: Model) -> DataFrame:
    """(batch, bucket, answer): log10 probability of each pair asked for, and the word's training count."""
    sums = corpus_sums(seats)

    @common.tidy
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])
        for own, totals, asked in read_seats(batches, model, sums):
            own.keep(model.sweeps, totals)
            logs, counts = np.log10(own.mean()).astype("<f4"), own.word_counts[own.word].astype("<u8")
            for number, data in asked:
                at = np.cumsum(unpacked(data)[0], dtype=np.uint32)
                yield pa.RecordBatch.from_pylist([{"batch": number, "bucket": own.bucket, "answer": packed(logs[at], counts[at])}], schema)

    return with_sums(seats, merged, requests=True).mapInArrow(answer, "batch long, bucket int, answer binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_texts(docs: DataFrame, holds: int, out_of: int, model: Model | None = None, buckets: int | None = None) -> DataFrame:
    """Scores of every text under a model of the texts whose crc32(doc_id) mod out_of is not holds.

    Tokens are the words, A-Z in lower case, and an end. n_known counts tokens with training tokens
    of the same word; base_score is the add-one unigram score, score the model's log10 probability,
    perplexity 10 ** (-score / n_tokens). A null text is an empty one: its end is scored. A null
    doc_id counts as the empty text for the split. Repeated rows count, and are scored, each. Without
    training texts all probability is the unknown word's. An empty table gives no rows.

    buckets (default: the session's shuffle partitions) should keep corpus / buckets within a task's
    memory; contexts are dealt to as many ranges. Words are told apart by 64-bit hashes. If Spark repeats a lost
    task, docs has to give it the same rows in the same order, as files and written tables do.
    """
    spark, model = docs.sparkSession, model or Model()
    common.ship(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_released(spark):
        merged = merge_buckets(count_pairs(docs, holds, out_of, buckets, model.classes))
        folders = [shared_folder(spark, "pitman-yor-seats") for _ in range(2)]
        seats = written(seated(merged, model, buckets), folders[0])
        _, _, tokens, known = corpus_sums(seats)
        for turn in range(model.sweeps):
            seats = written(swept(seats, merged, model, turn, buckets), folders[(turn + 1) % 2])
        found = materialize(answers(seats, merged, model), "pitman-yor-answers")

    @common.tidy
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, parts in zip(*batch.columns, strict=True):
                doc_ids, nulls, held, sizes, step = unpacked(data.as_py())
                got = [unpacked(x["answer"]) for x in parts.as_py()]
                logs, counts = (np.concatenate(x) for x in zip(*got, strict=True))
                at = np.cumsum(step, dtype=np.uint32)
                first = np.cumsum(sizes, dtype=np.int64) - sizes
                sizes = sizes.astype(np.int64)
                score = np.add.reduceat(logs.astype(float)[at], first)
                base = np.add.reduceat(np.log10(counts + 1.0)[at], first) - sizes * np.log10(tokens + known + 1.0)
                n_known = np.add.reduceat((counts > 0)[at].astype(np.int64), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes), pa.array(n_known), pa.array(np.full(len(sizes), tokens)),
                     pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300.0))],
                    names=[x.split()[0] for x in SCORES.split(", ")])

    found = found.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))  # no more than a batch asked for
    texts = merged.where("tokens is not null").select("batch", "tokens")
    return texts.join(found, "batch").select("tokens", "answers").mapInArrow(add_up, SCORES)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.read_table(spark, sf_dir, "documents"), holds=2, out_of=7)

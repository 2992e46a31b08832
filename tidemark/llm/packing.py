"""Packing of tokenised documents into fixed-length sequences as a cutting-stock problem.

Documents are cut at multiples of the sequence length; full pieces are sequences of their own, and
what is left of each document is an item to pack whole. Items are counted in a histogram of length
bins, a table whose size does not grow with the corpus. On it the driver solves the linear program
"fewest padded tokens" by column generation: the program's prices go into a knapsack (dynamic
programming over the capacity), whose best filling is the next pattern. Patterns are used as often
as the solution's whole part says; the few items left are placed first-fit, longest first. Pieces
are ranked within their bin by Spark, and a rank says which sequence a piece goes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, tokenize
from tidemark.llm.tokenize import encoder, slices
from tidemark.session import materialize, shared_folder

#: Characters encoded together, and segments that a worker keeps, where other stages have used the worker's
#: memory before; where packing stands alone, what tokenising takes by itself saves time.
SMALL = (2_000_000, 250_000)
ALONE = (tokenize.BATCH_CHARS, tokenize.KEPT_SEGMENTS)
PIECES = "piece long, part long, doc_id long, start long, length long, doc_tokens long, bin long, rank long, ids binary"


def fillings(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each exact total size 0..capacity, and the item added last."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    for total in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, total, "right"))
        if n:
            gain = best[total - sizes[:n]] + values[:n]
            k = int(np.argmax(gain))
            if gain[k] > -np.inf:
                best[total], last[total] = gain[k], k
    return best, last


def pattern_at(sizes: np.ndarray, last: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros(len(sizes))
    while total:
        out[last[total]] += 1
        total -= sizes[last[total]]
    return out


def padded(total: int, capacity: int) -> int:
    """Length of a sequence of so many units: a power of two needs no padding."""
    return total if total & (total - 1) == 0 else capacity


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """As many patterns as sizes, each used until one size runs out: a feasible basis.

    A pattern holds the longest item left and the fullest choice of the others, with a preference
    for sizes of which much is left.
    """
    left, alive = demand.copy(), np.ones(len(sizes), bool)
    base, cost = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    for _ in range(len(sizes)):
        live = np.flatnonzero(alive)
        some, top = sizes[live], live[-1]
        best, last = fillings(some, some * (1 + 1e-3 * left[live] / left[live].max()), capacity - sizes[top])
        column = np.zeros(len(sizes))
        column[live] = pattern_at(some, last, int(np.argmax(best)))
        column[top] += 1
        inside = np.flatnonzero(column)
        times = left[inside] / column[inside]
        gone = inside[np.argmin(times)]
        left[inside] = np.maximum(left[inside] - times.min() * column[inside], 0)
        alive[gone] = False
        base[:, gone], cost[gone] = column, padded(int(column @ sizes), capacity)
        left[live] = np.maximum(left[live], 1e-9)
    return base, cost


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-5, most_steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each (fractions) for the least padded length.

    Stops at the optimum, within `gap` of the length of the items themselves, or after
    `most_steps` exchanges; any stop leaves a valid plan.
    """
    base, cost = first_basis(sizes, demand, capacity)
    inverse = np.linalg.inv(base)
    used = np.maximum(inverse @ demand, 0)
    least = float(sizes @ demand)
    tops = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
    for step in range(most_steps):
        if cost @ used <= least * (1 + gap):
            break
        prices = cost @ inverse
        best, last = fillings(sizes, prices, capacity)
        any_total = int(np.argmax(best))
        options = [(best[t] - t, t) for t in tops] + [(best[any_total] - capacity, any_total)]
        gain, total = max(options)
        if gain <= 1e-7 * capacity:
            break
        column = pattern_at(sizes, last, total)
        along = inverse @ column
        rows = np.flatnonzero(along > 1e-9)
        if not len(rows):
            break
        ratio = used[rows] / along[rows]
        out = rows[np.argmin(ratio)]
        base[:, out], cost[out] = column, padded(total, capacity)
        if step % 100 == 99:
            inverse = np.linalg.inv(base)
            used = np.maximum(inverse @ demand, 0)
        else:
            take = ratio.min()
            pivot = inverse[out] / along[out]
            inverse -= np.outer(along, pivot)
            inverse[out] = pivot
            used = np.maximum(used - take * along, 0)
            used[out] = take
    return base, used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, first sequence, pieces of this bin in each sequence).

    histogram: items per bin 1..capacity. Its size, and so the plan's, depends on the number of
    bins only. Whole parts of the solution first, then first-fit-decreasing for the rest.
    """
    taken = dict.fromkeys(histogram, 0)
    out, sequences = [], 0

    def use(counts: dict[int, int], times: int) -> None:
        nonlocal sequences
        for b, n in counts.items():
            out.append((b, taken[b], taken[b] + n * times, sequences, n))
            taken[b] += n * times
        sequences += times

    if histogram.get(capacity):
        use({capacity: 1}, histogram[capacity])
    bins = sorted(b for b, n in histogram.items() if n and b != capacity)
    if bins:
        sizes, demand = np.array(bins), np.array([float(histogram[b]) for b in bins])
        base, used = solve(sizes, demand, capacity)
        for k in np.argsort(-used).tolist():
            counts = {bins[i]: int(base[i, k]) for i in np.flatnonzero(base[:, k]).tolist()}
            times = min([int(used[k] + 1e-9), *((histogram[b] - taken[b]) // n for b, n in counts.items())])
            if times > 0:
                use(counts, times)
        room: list[int] = []
        filled: list[dict[int, int]] = []
        for b in reversed(bins):
            for _ in range(histogram[b] - taken[b]):
                k = next((i for i, free in enumerate(room) if free >= b), None)
                if k is None:
                    k = len(room)
                    room.append(capacity)
                    filled.append({})
                room[k] -= b
                filled[k][b] = filled[k].get(b, 0) + 1
        for counts in filled:
            use(counts, 1)
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, unit: int, kind: str = "words", room: tuple[int, int] = SMALL) -> DataFrame:
    """Tokenised pieces with their ids (little-endian uint32), written once to the shared folder.

    `bin` is a piece's length in units, rounded up; `rank` counts pieces of a bin within `part`.
    """

    @common.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer, kind, room[1]), TaskContext.get().partitionId()
        seen, made = np.zeros(length // unit + 1, np.int64), 0
        for batch in batches:
            for first, texts in slices(batch.column(1).fill_null(""), room[0]):
                flat, at = tool.ids(texts)
                ids = np.insert(flat, at[1:], end_id).astype("<u4")
                sizes = np.diff(at) + 1
                n = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, sizes[doc] - start)
                bins = -(-size // unit)
                by_bin = np.argsort(bins, kind="stable")
                runs = bins[by_bin]
                begins = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.empty(0, int)
                rank = np.empty(len(doc), np.int64)
                rank[by_bin] = np.arange(len(doc)) - np.repeat(begins, np.diff(np.append(begins, len(doc)))) + seen[runs]
                seen += np.bincount(bins, minlength=len(seen))
                ends = 4 * np.concatenate([[0], np.cumsum(size)])
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(ids.tobytes())])
                own = batch.column(0).slice(first, len(texts)).take(pa.array(doc))
                piece = (part << 40) + made + np.arange(len(doc))
                made += len(doc)
                full = np.full(len(doc), part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece), pa.array(full), own, pa.array(start), pa.array(size), pa.array(sizes[doc]), pa.array(bins), pa.array(rank), data.cast(pa.binary())],
                    names=["piece", "part", "doc_id", "start", "length", "doc_tokens", "bin", "rank", "ids"])

    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = shared_folder(spark, "pieces")
    rows.mapInArrow(cut, PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def assign(pieces: DataFrame, length: int, unit: int) -> DataFrame:
    """piece, sequence_id and offset of every piece; sequences are numbered from 0."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("part", "bin").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most length / unit rows
    table = spark.createDataFrame(plan(histogram, length // unit), "bin long, low long, high long, first long, each long")
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.select("piece", "part", "bin", "rank", "length").join(offsets, ["part", "bin"])
    ranked = ranked.select("piece", "bin", "length", (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.join(F.broadcast(table), "bin").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select("piece", "length", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # at most `length` pieces
    return placed.select("piece", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, unit: int = 4, kind: str = "words",
         room: tuple[int, int] = SMALL) -> tuple[DataFrame, DataFrame]:
    """Pieces with their ids, and where each goes (piece, sequence_id, offset).

    Null texts are empty and hold the end id alone; null or repeated doc_ids are kept, since pieces
    have numbers of their own. An empty table gives two empty tables.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, length, unit, kind, room)
    return pieces, assign(pieces, length, unit)


def sequences(pieces: DataFrame, places: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (uint32 bytes, padded to `length` unless a power of two) and n_tokens.

    This shuffles the ids, as writing packed training files must.
    """
    parts = pieces.select("piece", "ids").join(places, "piece")
    joined = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most `length` pieces
    ids = F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"])))
    n = (F.length(ids) / 8).cast("int")
    power = F.bin(n).rlike("^10*$")
    pad = F.hex(F.lit(int(pad_id).to_bytes(4, "little")))
    return joined.select("sequence_id", n.cast("long").alias("n_tokens"), F.unhex(F.when(power, ids).otherwise(F.concat(ids, F.repeat(pad, F.lit(length) - n)))).alias("ids"))


def checksums(pieces: DataFrame) -> DataFrame:
    """crc32 of each piece's ids."""
    return pieces.select("piece", "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packed_pieces(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packed_rows(common.read_table(spark, sf_dir, "documents"), tokenizer, ALONE)


def packed_rows(docs: DataFrame, tokenizer: str | None = None, room: tuple[int, int] = SMALL) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `room` says how many
    characters are encoded together and how many segments a worker keeps."""
    import public_tokenizers

    pieces, places = pack(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), room=room)
    return checksums(pieces).join(places, "piece").drop("piece")

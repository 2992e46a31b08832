"""Exact removal of repeated byte strings, by a logarithmic family of sparse suffix arrays.

Suffixes. Of all suffixes of the texts, an array holds those that begin at anchors: a window of LENGTH
bytes has its anchor where the least hash of HEAD bytes lies inside it, so equal windows have their
anchors at equal places, and about one suffix in 170 is kept. An anchor owns the windows that chose
it, a run of starts. Arrays are tables sorted by the fingerprint of the suffix's head and then by that
of everything its windows cover; equal heads are neighbours, as they are in order of the bytes.

Family. A batch of documents becomes a sorted array. It is scanned together with the arrays of the
levels, which finds the heads that occur again; then it joins the family: two arrays of one size are
merged into one of twice the size, until no two sizes are equal. n batches leave at most log2(n) + 1
arrays, and each suffix is rewritten at most log2(n) times.

Matches. Where everything that an anchor's windows cover occurs twice, all its windows are repeated.
The others, at the edges of matches, are cut in blocks of BLOCK starts. All windows of a block share a
core; blocks that share their core meet by it, with the few bytes left and right of it, and are
compared start by start. Nothing is sampled: every window belongs to one anchor and one block.

Texts are copied once into compressed files, so that later steps read them beside the places found
in them, and only fingerprints and edges are shuffled. Hot heads, cores and edges are counted before
they meet, and go back to their places by equi joins, which adaptive execution splits by skew.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_128_digest

from tidemark.llm import common, files
from tidemark.session import materialize, shared_folder

#: Bytes of a string that counts as repeated, and of the head that anchors are chosen by.
LENGTH, HEAD = 400, 64
#: Window starts that share a core.
BLOCK = 32
#: Windows whose anchors are chosen together; positions need this many bits.
STRIDE_BITS = 21
MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Sizes:
    length: int = LENGTH
    head: int = HEAD
    block: int = BLOCK

    @property
    def core(self) -> int:
        """Bytes that all windows of a block share."""
        return self.length - self.block + 1


# --- anchors, in numpy ---


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each byte, powers of an odd multiplier modulo 2^64, and their inverses."""
    values = np.random.default_rng(20_240_607).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
    n = (1 << STRIDE_BITS) + 1
    inverse = pow(MULTIPLIER, -1, 2**64)
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, ...]:
    """Arrays (head, cover, anchor, first, last) for the windows of `data`: each run of window starts
    [first, last] with one anchor, the fingerprint of the head there and of all bytes that the run
    covers. data has at most 2^STRIDE_BITS bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < sizes.length:
        return none, none, none, none, none
    values, up, down = powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    heads = mixed((sums[sizes.head :] - sums[: -sizes.head]) * down[: len(data) - sizes.head + 1])
    low = np.uint64((1 << STRIDE_BITS) - 1)
    # The place in the low bits: of equal hashes the leftmost is least.
    least = least_of_windows((heads & ~low) | np.arange(len(heads), dtype=np.uint64), sizes.length - sizes.head + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    cover = (sums[last + sizes.length] - sums[first]) * down[first]
    cover = mixed(cover + mixed((at - first).astype(np.uint64) + np.uint64(1))) ^ mixed((last - first).astype(np.uint64) * np.uint64(MULTIPLIER))
    return heads[at].view(np.int64), cover.view(np.int64), at, first, last


def text_anchors(data: np.ndarray, sizes: Sizes) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of a text of any length, taken in strides that overlap by a window."""
    stride = 1 << STRIDE_BITS
    for start in range(0, max(1, len(data) - sizes.length + 1), stride - sizes.length + 1):
        head, cover, at, first, last = anchors(data[start : start + stride], sizes)
        yield head, cover, at + start, first + start, last + start


# --- texts in files of their own ---

CHUNK_BYTES = 8 << 20


def file_name(number: int) -> str:
    return f"texts-{number:016x}"


class TextWriter:
    """Writes texts to a compressed file; number names it and is new for each task attempt."""

    def __init__(self, folder: str, id_type: pa.DataType):
        self.number = int.from_bytes(os.urandom(8), "little") >> 2
        system, path = files.filesystem(folder)
        system.create_dir(path, recursive=True)
        self.stream = system.open_output_stream(f"{path}/{file_name(self.number)}")
        self.schema = pa.schema([("doc_id", id_type), ("text", pa.large_string())])
        self.writer = pa.ipc.new_stream(self.stream, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def write(self, ids: pa.Array, texts: pa.Array) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays([ids, texts.cast(pa.large_string())], schema=self.schema))

    def close(self) -> None:
        self.writer.close()
        self.stream.close()


def read_texts(folder: str, number: int) -> Iterator[tuple[int, object, bytes]]:
    """(row, doc_id, text) of a file that TextWriter wrote, in order."""
    row = 0
    with files.open_file(folder, file_name(number)) as source, pa.ipc.open_stream(source) as reader:
        for batch in reader:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary()), strict=True):
                yield row, doc_id.as_py(), text.as_py()
                row += 1


# --- suffix arrays ---

#: place: the text's row in its file, and below it the anchor; shape: bytes from the first start to the
#: anchor, and below it starts after the first. Narrow rows, since arrays are shuffled with each merge.
SUFFIX = "batch int, head long, cover long, file long, place long, shape int"
ANCHOR = (1 << 32) - 1
FILES = -1


def suffixes(docs: DataFrame, folder: str, batches: int, sizes: Sizes) -> DataFrame:
    """The sampled suffixes of all texts, which are written to files in folder on the way.

    Documents are dealt to batches by a hash of doc_id. A row of batch FILES stands for each file.
    """
    schema = T.StructType.fromDDL(SUFFIX)
    target = to_arrow_schema(schema)
    id_type = to_arrow_schema(docs.select("doc_id").schema).field(0).type
    rows = docs.select("doc_id", common.text_of().alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))

    @common.tidy
    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, row = None, 0
        for batch in records:
            writer = writer or TextWriter(folder, id_type)
            begin = 0
            sizes_of = np.diff(np.frombuffer(batch.column("text").cast(pa.large_string()).buffers()[1], np.int64, len(batch) + 1, batch.column("text").offset * 8)) if len(batch) else []
            while begin < len(batch):
                end, total = begin, 0
                while end < len(batch) and (end == begin or total + sizes_of[end] <= CHUNK_BYTES):
                    total += int(sizes_of[end])
                    end += 1
                part = batch.slice(begin, end - begin)
                writer.write(part.column("doc_id"), part.column("text"))
                found: list[tuple] = []
                for k, (number, text) in enumerate(zip(part.column("batch").to_pylist(), part.column("text").cast(pa.large_string()).cast(pa.large_binary()), strict=True)):
                    data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer().size else np.zeros(0, np.uint8)
                    found += [(number, row + k, *x) for x in text_anchors(data, sizes) if len(x[0])]
                row += end - begin
                begin = end
                if found:
                    counts = [len(x[2]) for x in found]
                    head, cover, at, first, last = (np.concatenate([x[i] for x in found]) for i in range(2, 7))
                    of_row = np.repeat(np.array([x[1] for x in found], np.int64), counts)
                    shape = ((at - first) << 16 | (last - first)).astype(np.int32)
                    columns = [np.repeat(np.array([x[0] for x in found], np.int32), counts), head, cover, np.full(len(head), writer.number), of_row << 32 | at, shape]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=target)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"batch": FILES, "file": writer.number}], schema=target)

    return rows.mapInArrow(run, schema)


#: More than a head has suffixes in the levels.
NEW = 2.0**52


@dataclass
class Family:
    """Suffix arrays of sizes 1, 2, 4, ... batches, and the heads that were met again."""

    levels: list[tuple[int, DataFrame, str]] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)

    def write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """rows as an array, sorted by head and cover over the ranges of its files."""
        spark = rows.sparkSession
        path = shared_folder(spark, "suffix-array")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, "head", "cover", "file", "place").sortWithinPartitions("head", "cover").write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), path

    def add(self, batch: DataFrame) -> None:
        """Takes in the suffixes of a batch: sort, scan against all levels, merge equal levels. Merges that follow from each other are one."""
        size, (array, path) = 1, self.write(batch)
        self.scan(array)
        parts = [(array, path)]
        while self.levels and self.levels[-1][0] == size:
            parts.append(self.levels.pop()[1:])
            size *= 2
        if len(parts) > 1:
            array, path = self.write(reduce(DataFrame.unionByName, (rows for rows, _ in parts)))
            for _, old in parts:  # the merged array is committed and reads none of them
                remove(batch.sparkSession, old)
        self.levels.append((size, array, path))

    def scan(self, array: DataFrame) -> None:
        """Notes each head of array that occurs twice, in array or in a level. One number a head keeps the
        rows that meet narrow: it counts suffixes of levels as one and those of array as NEW, so it is
        above NEW if there is one of array and another. A double can't overflow, and is exact up to there."""
        runs = [array.select("head", F.lit(NEW).alias("n")), *(level.select("head", F.lit(1.0).alias("n")) for _, level, _ in self.levels)]
        heads = reduce(DataFrame.unionByName, runs).groupBy("head").agg(F.sum("n").alias("n"))
        self.found.append(materialize(heads.where(F.col("n") > NEW).select("head"), "heads-again"))

    def repeated(self) -> DataFrame:
        """Suffixes whose head occurs again."""
        heads = materialize(reduce(DataFrame.unionByName, self.found).distinct(), "all-heads-again")
        return reduce(DataFrame.unionByName, (level for _, level, _ in self.levels)).join(heads, "head", "left_semi")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an array that a merged one replaces."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- matches ---


def by_file(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "file").sortWithinPartitions("file", "place")


def blocks(open_: DataFrame, folder: str, sizes: Sizes) -> DataFrame:
    """Blocks of window starts of each suffix in open_: the core's digest, the bytes left and right of it, and the place of the core."""
    schema = T.StructType.fromDDL("core binary, left_bytes binary, right_bytes binary, file long, place long")
    target = to_arrow_schema(schema)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, now, row, text = None, None, -1, b""
        for batch in batches:
            out: list[list] = [[] for _ in target]

            def columns() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

            for file, place, shape in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of_row, anchor = place >> 32, place & ANCHOR
                first = anchor - (shape >> 16)
                last = first + (shape & 0xFFFF)
                if file != now:
                    texts, now, row = read_texts(folder, file), file, -1
                while row < of_row:
                    row, _, text = next(texts)
                for j in range((anchor - last) // sizes.block, (anchor - first) // sizes.block + 1):
                    at = anchor - j * sizes.block
                    core = text[at : at + sizes.core]
                    left = text[max(first, at - sizes.block + 1) : at]
                    right = text[at + sizes.core : min(last, at) + sizes.length]
                    for column, value in zip(out, (xxh3_128_digest(core), left, right, file, row << 32 | at), strict=True):
                        column.append(value)
                if len(out[0]) >= 50_000:
                    yield columns()
                    out = [[] for _ in target]
            yield columns()

    return by_file(open_.select("file", "place", "shape")).mapInArrow(run, schema)


def digest(salt: int, *parts: str | Column) -> list[Column]:
    """A 128-bit digest as two numbers, which are shuffled where the bytes would be three times as wide."""
    return [F.xxhash64(F.lit(2 * salt + i), *parts, F.lit(i)) for i in range(2)]


def repeated_starts(cut: DataFrame, sizes: Sizes) -> DataFrame:
    """(file, place, n): n window starts from place on, in blocks that occur elsewhere too.

    Blocks with the same bytes are one cell. The window that begins i bytes before its core is told by the
    core, the i bytes left of it and the block - 1 - i bytes right of it.
    """
    most = sizes.block - 1
    k1, k2 = digest(1, "core", "left_bytes", "right_bytes")
    cell = cut.withColumns({"k1": k1, "k2": k2})
    cells = materialize(cell.groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.first("core").alias("core"), F.first("left_bytes").alias("left_bytes"), F.first("right_bytes").alias("right_bytes")), "blocks-counted")
    whole = cells.where("n > 1").select("k1", "k2", F.length("left_bytes").alias("far"), (most - F.length("right_bytes")).alias("near"))
    # Tables to join are written first: between plain tables, adaptive execution can split a hot core.
    shared = materialize(cells.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), "shared-cores")
    edge = cells.join(shared, "core", "left_semi").select(
        "k1", "k2", "n", "core", "left_bytes", "right_bytes", F.explode(F.sequence(most - F.length("right_bytes"), F.length("left_bytes"))).alias("i"))
    e1, e2 = digest(2, "core", "i", F.expr("substring(left_bytes, length(left_bytes) - i + 1, i)"), F.expr(f"substring(right_bytes, 1, {most} - i)"))
    edge = materialize(edge.select("k1", "k2", "n", F.col("i").cast("int").alias("i"), e1.alias("e1"), e2.alias("e2")), "edges")
    again = materialize(edge.groupBy("e1", "e2").agg(F.sum("n").alias("total")).where("total > 1").select("e1", "e2"), "edges-again")
    single = edge.where("n = 1").select("k1", "k2", "i", "e1", "e2").join(again, ["e1", "e2"], "left_semi").select("k1", "k2", F.col("i").alias("far"), F.col("i").alias("near"))
    found = materialize(whole.unionByName(single), "blocks-again")
    return cell.select("k1", "k2", "file", "place").join(found, ["k1", "k2"]).select(
        "file", (F.col("place") - F.col("far")).alias("place"), (F.col("far") - F.col("near") + 1).cast("int").alias("n"))


def matches(family: Family, folder: str, sizes: Sizes) -> DataFrame:
    """(file, place, n): runs of starts whose windows occur elsewhere too."""
    again = materialize(family.repeated(), "suffixes-again")
    covers = materialize(again.groupBy("head", "cover").agg(F.count("*").alias("n"), F.min(F.struct("file", "place", "shape")).alias("one")), "covers")
    twice = materialize(covers.where("n > 1").select("head", "cover"), "covers-again")
    first = F.col("place") - F.shiftright("shape", 16)
    whole = again.join(twice, ["head", "cover"], "left_semi").select("file", first.alias("place"), (F.col("shape").bitwiseAND(0xFFFF) + 1).alias("n"))
    differing = materialize(covers.groupBy("head").agg(F.count("*").alias("c")).where("c > 1").select("head"), "heads-differing")
    one_of_each = covers.join(differing, "head", "left_semi").select("one.*")
    cut = materialize(blocks(one_of_each, folder, sizes), "blocks")
    return whole.unionByName(repeated_starts(cut, sizes))


# --- results ---


def stripped(found: DataFrame, every_file: DataFrame, folder: str, id_type: T.DataType, sizes: Sizes, with_text: bool) -> DataFrame:
    """A row per document: bytes, removed bytes and runs, the SHA-256 of what is left, and, if asked for, these bytes."""
    fields = [T.StructField("doc_id", id_type), *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")]
    schema = T.StructType(fields if with_text else fields[:-1])
    target = to_arrow_schema(schema)
    starts = every_file.select("file", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("n"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"texts": iter(()), "file": None, "row": -1, "spans": []}
        out: list[dict] = []

        def judge(doc_id, text: bytes, spans: list[tuple[int, int]]) -> None:
            runs: list[list[int]] = []
            for first, end in spans:
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([first, end])
            ends = [0, *(x for r in runs for x in r), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if runs else text
            row = {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | {"kept": kept} if with_text else row)

        def reach(row: int | None) -> None:
            """Gives out the file's documents before `row`, or all that are left."""
            while row is None or state["row"] < row:
                spans, state["spans"] = state["spans"], []
                if state["row"] >= 0:
                    judge(*state["doc"], spans)
                try:
                    state["row"], *state["doc"] = next(state["texts"])
                except StopIteration:
                    state["row"] = -1
                    return

        for batch in batches:
            for file, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != state["file"]:
                    reach(None)
                    state |= {"texts": read_texts(folder, file), "file": file, "row": -1, "spans": []}
                    reach(0)
                if n:
                    reach(place >> 32)
                    first = place & ANCHOR
                    state["spans"].append((first, first + n - 1 + sizes.length))
                if len(out) >= 2000 or with_text and sum(len(x["kept"]) for x in out[-64:]) > CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out.clear()
        reach(None)
        yield pa.RecordBatch.from_pylist(out, schema=target)

    return by_file(starts.unionByName(found)).select("file", "place", "n").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, batches: int = 4, sizes: Sizes = Sizes(), with_text: bool = False) -> DataFrame:
    """Documents with every byte removed that lies in a string of sizes.length bytes which also starts elsewhere.

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the bytes
    left, which may end inside a character). Texts are taken as UTF-8; null ones are empty. Rows that
    repeat each other are copies of each other. An empty table gives no rows. Texts shorter than the
    length have no windows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    folder = shared_folder(spark, "texts")
    rows = suffixes(docs, folder, batches, sizes)
    path = shared_folder(spark, "suffixes")
    rows.write.partitionBy("batch").parquet(path)
    everything = spark.read.schema(rows.schema).parquet(path)
    family = Family()
    for number in range(batches):
        family.add(everything.where(F.col("batch") == number).drop("batch"))
        remove(spark, f"{path}/batch={number}")  # its array holds it now
    every_file = everything.where(F.col("batch") == FILES)
    return stripped(matches(family, folder, sizes), every_file, folder, docs.schema["doc_id"].dataType, sizes, with_text)


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.read_table(spark, sf_dir, "documents"))

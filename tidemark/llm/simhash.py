"""SimHash near-duplicates, found through deletion-variant signatures.

A fingerprint's 64 bits are cut into so few segments (max_bits // 2 + 1) that two fingerprints which
differ in at most max_bits bits have one segment that differs in at most one bit. Each fingerprint
is entered under every segment with each of its bits left out in turn: equal segments share all of
these keys, and segments that differ in one bit share one. Distinct fingerprints meet by equality
of the key and are verified on all 64 bits.

Keys are streamed in sorted order. Within a short run all pairs are verified together; within a
long run links are followed from fingerprint to fingerprint, so that the run yields one link per
member at most; a run beyond BLOCK members goes in blocks to a second job, which takes each pair of
blocks as a task of its own. No link is lost, only links between fingerprints that are already
linked through others are not repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import common
from tidemark.llm.components import connected_components
from tidemark.session import materialize

BITS = 64
#: Runs up to this length yield their links pair by pair.
SHORT = 48
#: Members of a run that one task compares with each other.
BLOCK = 4096


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit integer; 0 without words."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    line = b" ".join(parts)
    if n <= words:
        hashes = np.array([xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = [x - 1 for x in accumulate(len(p) + 1 for p in parts)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        count += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp of every document; a null text is an empty one."""

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(read, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment. At least two, so that a segment and the
    position of its missing bit fit one key."""
    n = max(2, max_bits // 2 + 1)
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variant_keys(fp: str, max_bits: int) -> Column:
    """All 64 one-wildcard segment variants: the missing bit's place, then the segment without it."""
    keys = []
    for start, n in segments(max_bits):
        part = F.shiftrightunsigned(F.col(fp), start).bitwiseAND(F.lit((1 << n) - 1)) if n < BITS else F.col(fp)
        keys += [part.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << j))).bitwiseOR(F.lit((start + j) << 32)) for j in range(n)]
    return F.array(*keys)


def linked(a: np.ndarray, b: np.ndarray, place: np.ndarray | int, max_bits: int) -> np.ndarray:
    """Pairs within max_bits, and of the keys that the two share, the first: so each link counts once."""
    x = a ^ b
    near = np.bitwise_count(x) <= max_bits
    first = np.zeros(near.shape, bool)
    open_ = np.ones(near.shape, bool)
    for start, n in segments(max_bits):
        part = (x >> np.uint64(start)) & np.uint64((1 << n) - 1)
        here = open_ & (place >= start) & (place < start + n)
        rel = np.where((place >= start) & (place < start + n), place - start, 0).astype(np.uint64)
        first |= here & ((part == (np.uint64(1) << rel)) | ((part == 0) & (rel == 0)))
        open_ &= np.bitwise_count(part) > 1
    return near & first


def short_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; meant for short runs."""
    left, right = [], []
    at, d = np.arange(len(key)), 0
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        a, b = fp[at], fp[at + d]
        keep = linked(a, b, key[at] >> 32, max_bits)
        left.append(a[keep])
        right.append(b[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def tree_links(place: int, members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One link per member of a run that has a link: a tree over each of its connected parts."""
    rest, left, right = members, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = linked(np.full(len(rest), x), rest, place, max_bits)
            if near.any():
                got = rest[near]
                left.append(np.full(len(got), x))
                right.append(got)
                queue.extend(got)
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (members[:0], members[:0])


FOUND = "a long, b long, key long, chunk int, members binary"


def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *none], names=["a", "b", "key", "chunk", "members"])


def too_long(key: int, chunk: int, members: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([chunk], pa.int32()), pa.array([members.tobytes()], pa.binary())],
        names=["a", "b", "key", "chunk", "members"])


def similar_fingerprints(prints: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct values of fp that connect all pairs within max_bits."""

    @common.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, chunks = np.empty(0, np.int64), np.empty(0, np.uint64), {}

        def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole runs."""
            if not len(key):
                return
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            short = np.repeat((size > 1) & (size <= SHORT), size)
            a, b = short_links(key[short], fp[short], max_bits)
            if len(a):
                yield found(a, b)
            for k in np.flatnonzero(size > SHORT).tolist():
                members = np.unique(fp[begin[k] : begin[k] + size[k]])
                a, b = tree_links(int(key[begin[k]]) >> 32, members, max_bits)
                if len(a):
                    yield found(a, b)

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last and int(key[0]) in chunks:  # the rest of a run that goes in blocks
                end = int(np.searchsorted(key, key[0], "right"))
                yield too_long(int(key[0]), chunks.pop(int(key[0])), fp[:end])
                key, fp, last = key[end:], fp[end:], last - end
            yield from closed(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            while len(key) >= block:
                chunks[int(key[0])] = chunks.get(int(key[0]), 0) + 1
                yield too_long(int(key[0]), chunks[int(key[0])] - 1, fp[:block])
                key, fp = key[block:], fp[block:]
        if len(key) and int(key[0]) in chunks:
            yield too_long(int(key[0]), chunks[int(key[0])], fp)
        else:
            yield from closed(key, fp)

    @common.tidy
    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = np.unique(np.frombuffer(row["m1"] + (row["m2"] if row["c1"] != row["c2"] else b""), np.uint64))
                a, b = tree_links(row["key"] >> 32, members, max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    common.ship(prints.sparkSession)
    variants = prints.select("fp").distinct().select(F.explode(variant_keys("fp", max_bits)).alias("key"), "fp")
    met = materialize(variants.repartition("key").sortWithinPartitions("key").mapInArrow(meet, FOUND), "simhash-runs")
    blocks = met.where("members is not null").select("key", "chunk", "members")
    one = blocks.select("key", F.col("chunk").alias("c1"), F.col("members").alias("m1"))
    two = blocks.select("key", F.col("chunk").alias("c2"), F.col("members").alias("m2"))
    pairs = one.join(two, "key").where("c1 <= c2").repartition("key", "c1", "c2")
    return met.where("members is null").select("a", "b").unionByName(pairs.mapInArrow(cross, "a long, b long"))


def near_duplicates(docs: DataFrame, max_bits: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row.

    Texts without words have fingerprint zero and are linked like others. Rows without a doc_id get
    a fingerprint, the component of equal fingerprints, and link no others; null where none has a doc_id.
    Rows that repeat a doc_id are separate rows with that doc_id. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = similar_fingerprints(prints, max_bits)
    for side in ("a", "b"):
        links = links.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"doc_{side}")), side)
    roots = connected_components(links.where("doc_a is not null and doc_b is not null"), "doc_a", "doc_b")
    # A component of several doc_ids may be reached through one doc_id under several fingerprints.
    named = least.join(roots, F.col("least") == F.col("node"), "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    # Written, so that the join below stands alone in its stage and Spark can split a fingerprint of very many rows.
    named = materialize(named, "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

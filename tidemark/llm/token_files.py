"""Token ids of a corpus in binary files of patched frame-of-reference blocks.

A file holds documents in ascending doc_id order:

    "TIDEPFR1"
    blocks            of BLOCK ids each, the last one shorter
    block starts      uint64 each
    documents         doc_id int64 each, then a null mark uint8 each, then n_tokens uint64 each
    footer            n_blocks, n_docs, n_tokens, where the block starts begin: uint64 each

    block: count uint32, minimum uint32, outliers uint16, width uint8, spare uint8
           width x 8 bytes for every 64 values: the low `width` bits of value - minimum
           outlier positions uint16 each, their remaining high bits uint32 each

The width covers the chosen share of a block's values; the rest are outliers ("patches"). Block
starts allow a reader to decode any document without the blocks before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, files
from tidemark.llm.tokenize import encoder, slices
from tidemark.session import materialize, shared_folder

MAGIC = b"TIDEPFR1"
BLOCK = 1024
HEAD = np.dtype([("count", "<u4"), ("minimum", "<u4"), ("outliers", "<u2"), ("width", "u1"), ("spare", "u1")])
FOOTER = struct.Struct("<4Q")
MANIFEST = "file string, first_doc long, turn long, n_docs long, n_tokens long"


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values below 2**width -> (n, BLOCK * width / 64) 64-bit words."""
    lanes = values.reshape(len(values), -1, 64)
    out = np.zeros((*lanes.shape[:2], width), "<u8")
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= lanes[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), -1, max(width, 1))
    out = np.zeros((len(words), BLOCK // 64, 64), "<u8")
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        got = lanes[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            got = got | lanes[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = got & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, share: float) -> list[bytes]:
    """Blocks of uint32 ids; `share` of a block's values fit its width, the others are outliers."""
    count = np.full(-(-len(ids) // BLOCK), BLOCK)
    if len(ids) % BLOCK:
        count[-1] = len(ids) % BLOCK
        ids = np.concatenate([ids, np.full(BLOCK - count[-1], ids[-1], ids.dtype)])
    blocks = ids.reshape(-1, BLOCK).astype("<u8")
    least = blocks.min(axis=1)
    blocks -= least[:, None]
    at = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    width = np.ceil(np.log2(np.partition(blocks, at, axis=1)[:, at] + 1.0)).astype(int)
    out: list[bytes] = [b""] * len(blocks)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = pack_words(blocks[rows] & np.uint64((1 << w) - 1), w)
        high = blocks[rows] >> np.uint64(w)
        row, place = np.nonzero(high)
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        patch = high[row, place].astype("<u4")
        for k, r in enumerate(rows.tolist()):
            a, b = cuts[k], cuts[k + 1]
            head = np.array([(count[r], least[r], b - a, w, 0)], HEAD)
            out[r] = b"".join((head.tobytes(), packed[k].tobytes(), place[a:b].astype("<u2").tobytes(), patch[a:b].tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks; starts are the blocks' places in data."""
    heads = np.array([np.frombuffer(data, HEAD, 1, s)[0] for s in starts.tolist()], HEAD)
    out = np.empty((len(heads), BLOCK), "<u4")
    for w in np.unique(heads["width"]).tolist():
        rows = np.flatnonzero(heads["width"] == w)
        n = BLOCK // 64 * w
        words = np.stack([np.frombuffer(data, "<u8", n, starts[r] + HEAD.itemsize) for r in rows.tolist()]) if n else np.zeros((len(rows), BLOCK // 64), "<u8")
        values = unpack_words(words, w)
        for k, r in enumerate(rows.tolist()):
            if m := int(heads["outliers"][r]):
                at = int(starts[r]) + HEAD.itemsize + 8 * n
                place = np.frombuffer(data, "<u2", m, at)
                values[k, place] |= np.frombuffer(data, "<u4", m, at + 2 * m).astype("<u8") << np.uint64(w)
        out[rows] = values + heads["minimum"][rows].astype("<u8")[:, None]
    return out.reshape(-1)[: int(heads["count"].sum())]


class FileWriter:
    """Writes one file; ids are turned into blocks as they come."""

    def __init__(self, folder: str, share: float):
        self.name, self.out = files.create(folder, "tokens")
        self.out.write(MAGIC)
        self.share, self.at, self.rest = share, len(MAGIC), np.empty(0, "<u4")
        self.starts: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, sizes))
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self.put(ids[:whole])
        self.rest = ids[whole:]

    def put(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids, self.share) if len(ids) else ():
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)

    def close(self) -> dict:
        self.put(self.rest)
        doc_ids, nulls, sizes = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        for x, kind in ((self.starts, "<u8"), (doc_ids, "<i8"), (nulls, "u1"), (sizes, "<u8")):
            self.out.write(np.asarray(x, kind).tobytes())
        self.out.write(FOOTER.pack(len(self.starts), len(doc_ids), self.tokens, self.at))
        self.out.close()
        return {"file": self.name, "first_doc": None if nulls[0] else int(doc_ids[0]), "n_docs": len(doc_ids), "n_tokens": self.tokens}


class FileReader:
    """Opens a file by its footer; ids(a, b) decodes only the blocks that hold ids a to b."""

    def __init__(self, folder: str, name: str):
        self.file = files.open_file(folder, name)
        size = self.file.size()
        n_blocks, n_docs, self.n_tokens, self.end = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        index = self.file.read_at(size - FOOTER.size - self.end, self.end)
        self.starts = np.frombuffer(index, "<u8", n_blocks).astype(np.int64)
        at = 8 * n_blocks
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        self.nulls = np.frombuffer(index, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(index, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.empty(0, "<u4")
        first, last = a // BLOCK, -(-b // BLOCK)
        at = int(self.starts[first])
        to = int(self.starts[last]) if last < len(self.starts) else self.end
        return decode_blocks(self.file.read_at(to - at, at), self.starts[first:last] - at)[a - first * BLOCK : b - first * BLOCK]

    def documents(self, at_once: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of documents, by position, with their ids in a row; a longer document stands alone."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + at_once, "right")) - 1)
            yield a, b, self.ids(int(ends[a]), int(ends[b]))
            a = b


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, kind: str = "bytes", share: float = 0.98, file_tokens: int = 1 << 28) -> DataFrame:
    """Encodes text by doc_id order into files below `folder`; one row per file, in order by first_doc.

    Null texts are empty; null doc_ids come first; rows with the same doc_id follow each other. An
    empty table writes no file. `share` of a block's values set its width. A task starts a new file
    after `file_tokens` ids.
    """

    @common.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, writer, done = encoder(tokenizer, kind), None, []
        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in slices(batch.column(1).fill_null("")):
                flat, at = tool.ids(texts)
                ids = np.insert(flat, at[1:], end_id).astype("<u4")
                own = doc_ids.slice(first, len(texts))
                writer = writer or FileWriter(folder, share)
                writer.add(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), np.diff(at) + 1, ids)
                if writer.tokens >= file_tokens:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist([x | {"turn": i} for i, x in enumerate(done)], pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("turn", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files, as read back: doc_id, start, n_tokens and crc32 of its ids.

    `start` counts the ids of all documents before it. Files are few (one per task that wrote), so
    their sizes are summed in one window; the files themselves are read in parallel.
    """

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, start = FileReader(folder, row["file"]), row["start"]
                for a, b, ids in reader.documents():
                    sizes = reader.sizes[a:b]
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids[a:b], mask=reader.nulls[a:b]), pa.array(start + ends[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    # Ranges of doc_ids do not overlap and nulls lie in the first; files that begin with the same
    # doc_id are of one task, which wrote them by turns.
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    spread = materialize(placed, "token-files").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-files")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return read_documents(write_token_files(common.read_table(spark, sf_dir, "documents"), path, 2, folder), folder)

"""WARC archives with a two-level capture index.

Pages are written in the order of their keys (URL with the host reversed), one gzip member per
record. The index has the same order: its lines are kept in compressed blocks, and a sparse
directory holds each block's first and last key and its place. A look-up searches the directory by
bisection, reads one block by its range, and then reads records by theirs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, files
from tidemark.session import materialize, shared_folder

#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIRECTORY = "block long, first_key string, last_key string, index_file string, index_offset long, index_length long, n_lines long"
CAPTURES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sort_key(url: str | Column) -> Column:
    """Reversed host, then what follows it: https://www.a.example/b?c -> example,a,www)/b?c.

    Scheme, user and port are left out of the host and its letters are lower-cased. Null or
    host-less text sorts by itself.
    """
    url = F.trim(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), path)


@dataclass(frozen=True)
class Archive:
    """A folder of archive files, and the directory of its index."""

    folder: str
    directory: DataFrame


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the payload's HTTP head and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> dict:
    """Headers and payload of one record; a response's payload must have its digest."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload,
    }


def with_originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with the page_id that a revisit refers to; null for responses.

    Only page numbers and digests are grouped and joined, and only repeated payloads come back.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    sizes = pages.where(F.octet_length("html") >= least_bytes).select("page_id", digest.alias("digest"), F.octet_length("html").alias("size"))
    first = sizes.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = sizes.join(first, ["digest", "size"]).where("page_id < refers_to").select("page_id", F.col("digest").alias("_digest"), "refers_to").distinct()
    revisits = materialize(revisits, "revisits").withColumnRenamed("page_id", "_page")
    return pages.join(revisits, (F.col("page_id") == F.col("_page")) & (digest == F.col("_digest")), "left").select("page_id", "url", "html", "refers_to")


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 1000, block_lines: int = 512, file_bytes: int = 1 << 30) -> Archive:
    """Writes every row of pages as a record, and the index.

    Of equal payloads of at least least_bytes, the one with the largest page_id is a response and the
    others are revisits; rows with that same largest page_id, and rows without a page_id, are
    responses. A null html is an empty payload, a null url an empty one. Repeated rows are repeated
    records. An empty table gives an archive without blocks.
    """

    @common.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = index = index_name = None
        at = index_at = 0
        lines: list[tuple[str, str]] = []

        def closed_block() -> pa.RecordBatch:
            nonlocal index_at, lines
            data = zlib.compress("\n".join(x for _, x in lines).encode(), 6)
            index.write(data)
            row = {"block": 0, "first_key": lines[0][0], "last_key": lines[-1][0], "index_file": index_name, "index_offset": index_at, "index_length": len(data), "n_lines": len(lines)}
            index_at += len(data)
            lines = []
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("index_file", pa.string()), ("index_offset", pa.int64()), ("index_length", pa.int64()), ("n_lines", pa.int64())]))

        for batch in batches:
            for key, page_id, url, html, refers_to in zip(*(c for c in batch.columns), strict=True):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    name, out = files.create(folder, "pages.warc.gz")
                    at = 0
                if index is None:
                    index_name, index = files.create(folder, "pages.cdx")
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                data = record(page_id.as_py(), url.as_py(), payload, hashlib.sha1(payload).digest(), refers_to.as_py())
                out.write(data)
                lines.append((key.as_py(), json.dumps([key.as_py(), page_id.as_py(), name, at, len(data)])))
                at += len(data)
                if len(lines) == block_lines:
                    yield closed_block()
        if lines:
            yield closed_block()
        for x in (out, index):
            if x:
                x.close()

    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = with_originals(rows, least_bytes).select(sort_key("url").alias("key"), "page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    ordered = keyed.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return Archive(folder, materialize(ordered.mapInArrow(write, DIRECTORY).drop("block"), "directory"))


def index_lines(folder: str, row: dict) -> list[list]:
    """[key, page_id, file, offset, length] of one block, by a range read."""
    data = files.open_file(folder, row["index_file"]).read_at(row["index_length"], row["index_offset"])
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def records(folder: str, lines: list[list], at_once: int = 1 << 24) -> Iterator[dict]:
    """Records of index lines; neighbours in a file are read by one range of bounded size."""
    i = 0
    while i < len(lines):
        j, name, begin = i + 1, lines[i][2], lines[i][3]
        while j < len(lines) and lines[j][2] == name and lines[j][3] == lines[j - 1][3] + lines[j - 1][4] and lines[j][3] + lines[j][4] - begin <= at_once:
            j += 1
        data = files.open_file(folder, name).read_at(lines[j - 1][3] + lines[j - 1][4] - begin, begin)
        for x in lines[i:j]:
            yield parse(data[x[3] - begin : x[3] - begin + x[4]])
        i = j


def capture_batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)


def read_archive(archive: Archive) -> DataFrame:
    """Every record, through the directory and the index; tasks take blocks."""
    folder = archive.folder

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if found := list(records(folder, index_lines(folder, row))):
                    yield capture_batch(found)

    spread = archive.directory.repartition(archive.directory.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, CAPTURES)


def look_up(archive: Archive, urls: DataFrame, directory_rows: int = 200_000) -> DataFrame:
    """Captures of a set of urls (column url). Null urls find the captures without a url.

    The directory is read in slices of at most `directory_rows` rows, ordered by key, and each slice
    is bisected by the queries that the tasks hold; so it is never needed whole.
    """
    folder, spark = archive.folder, urls.sparkSession
    wanted = materialize(urls.select(sort_key("url").alias("key")).distinct(), "wanted")
    place = {"first_key": "string", "last_key": "string", "index_file": "string", "index_offset": "long"}
    ordered = archive.directory.orderBy(*place)
    out, after = None, None
    while True:
        part = ordered if after is None else ordered.where(F.struct(*place) > F.struct(*(F.lit(after[x]).cast(t).alias(x) for x, t in place.items())))
        rows = [r.asDict() for r in part.limit(directory_rows).collect()]
        if not rows:
            break
        after = rows[-1]
        found = wanted.mapInArrow(searcher(folder, rows), CAPTURES)
        out = found if out is None else out.unionByName(found)
        if len(rows) < directory_rows:
            break
    return out if out is not None else spark.createDataFrame([], CAPTURES)


def searcher(folder: str, rows: list[dict]):
    """rows: a slice of the directory in key order, so that last keys ascend as well."""
    first, last = [r["first_key"] for r in rows], [r["last_key"] for r in rows]

    @common.tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for row in rows[bisect_left(last, key) : bisect_right(first, key)]:
                    lines = index_lines(folder, row)
                    keys = [x[0] for x in lines]
                    if found := list(records(folder, lines[bisect_left(keys, key) : bisect_right(keys, key)])):
                        yield capture_batch(found)

    return search


def op1_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(common.read_table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_archive(archive)


OP1_SQL = """
WITH p AS (
    SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS original FROM p)
SELECT page_id, coalesce(url, '') AS url, payload_bytes, payload_digest,
    CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < original THEN original END AS refers_to
FROM q
"""

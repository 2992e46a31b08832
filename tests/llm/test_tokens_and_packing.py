import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_files
from tidemark.llm.tokenize import Encoder

ODD = ["", " ", "a  b", "a   b", " \n b", "a\n\n\nb", "x \n", "x  ", "\n\nx", "a\tb \t c", "don't 's  's", "a\x1cb", "é é ́", "a\x00b c", "<|endoftext|> a<|endoftext|>b", "a\r\nb \r\n c",
       "Hello,world 123 4a5.", "a b", "  x", "İ ſ K ß.", "thing. thing, thing", "w" * 200 + " x", "日本 語, Ünïcode."]
KINDS = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}
SCHEMA = "doc_id long, text string, file string, piece string"


def rows(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "extra", "extra") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("kind", KINDS)
def test_segment_cache_gives_the_library_s_ids(kind):
    tool = Encoder(public_tokenizers.path(KINDS[kind]), kind)
    whole = Tokenizer.from_file(public_tokenizers.path(KINDS[kind]))
    for _ in range(2):
        flat, at = tool.ids(pa.array(ODD))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(x, add_special_tokens=False).ids for x in ODD]
    assert tool.ids(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("share", [0.5, 0.98, 1.0])
def test_blocks_round_trip(share):
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 50_000, 5000), np.where(rng.random(3000) < 0.02, 2**32 - 1, 7), np.zeros(1024), np.array([2**32 - 1])):
        ids = ids.astype("<u4")
        blocks = token_files.encode_blocks(ids, share)
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert token_files.decode_blocks(b"".join(blocks), starts).tolist() == ids.tolist()


def test_token_files_are_read_back_in_order(spark, tmp_path):
    docs = rows(spark, ODD + [None, "again"], 5).unionByName(rows(spark, ["again"], 29)).unionByName(rows(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    path = public_tokenizers.path(KINDS["bytes"])
    manifest = token_files.write_token_files(docs.repartition(3), path, 2, str(tmp_path), file_tokens=60)
    got = sorted(token_files.read_documents(manifest, str(tmp_path)).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(path)
    given = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    start = 0
    assert len(got) == len(given)
    for row, doc in zip(got, given):
        ids = np.array([*whole.encode(doc.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    name = manifest.orderBy("first_doc", "turn").first()["file"]
    reader = token_files.FileReader(str(tmp_path), name)
    assert reader.ids(1, 3).tolist() == reader.ids(0, reader.n_tokens)[1:3].tolist()
    empty = token_files.write_token_files(docs.limit(0), path, 2, str(tmp_path))
    assert token_files.read_documents(empty, str(tmp_path)).count() == 0


def test_plan_places_every_item_once_with_little_padding():
    rng = np.random.default_rng(1)
    sizes = np.ceil(np.minimum(2047, rng.gamma(1.5, 500, 20_000) + 1) / 4).astype(int).tolist() + [512] * 50
    histogram = {b: sizes.count(b) for b in set(sizes)}
    fill: dict[int, int] = {}
    for b, low, high, first, each in packing.plan(histogram, 512):
        for rank in range(low, high):
            k = first + (rank - low) // each
            fill[k] = fill.get(k, 0) + b
    assert max(fill.values()) <= 512
    assert sum(fill.values()) == sum(sizes)
    assert len(fill) * 512 < 1.01 * sum(sizes)


def test_column_generation_reaches_the_optimum():
    # Lengths 5 and 3 in 11 units: 5+3+3 fills a sequence, other patterns waste; the first basis need not hold it.
    base, used = packing.solve(np.array([3, 5]), np.array([20.0, 10.0]), 11, gap=0, most_steps=50)
    assert sum(packing.padded(int(c @ np.array([3, 5])), 11) * u for c, u in zip(base.T, used)) == pytest.approx(110)


def test_pieces_cover_documents_and_fit_sequences(spark):
    docs = rows(spark, ODD + [None, "many words " * 3000] + ["some words here " * n for n in range(1, 200)]).unionByName(rows(spark, ["twin"], 3))
    path = public_tokenizers.path(KINDS["words"])
    pieces, places = packing.pack(docs.repartition(3), path, length=256)
    got = packing.checksums(pieces).join(places, "piece").toPandas()
    whole = Tokenizer.from_file(path)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got.itertuples():
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert got.length.sum() == sum(len(x) for xs in ids.values() for x in xs)
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum()[:-1]] and one.length.sum() <= 256
    made = packing.sequences(pieces, places, length=256).collect()
    assert all(len(r.ids) in (4 * 256, 4 * r.n_tokens) for r in made) and sum(r.n_tokens for r in made) == got.length.sum()
    none, nowhere = packing.pack(docs.limit(0), path)
    assert none.count() == nowhere.count() == 0

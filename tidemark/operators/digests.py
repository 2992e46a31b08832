"""Digests and texts of sorted lists, with no list in a row.

The entries of a key are rows. They are dealt out by key and sorted, and a digest is carried along them
from batch to batch: a task holds the hash of the key it is at, whatever the number of its entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def json_entry(entry: Column) -> Column:
    """An entry as it stands in the JSON text of a list."""
    text = F.to_json(F.array(entry))
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Rows of a batch that have another key than the row above; the first one is among them."""
    if len(batch) < 2:
        return [0] * len(batch)
    changed = None
    for name in keys:
        c = batch.column(name)
        above, here = c.slice(0, len(c) - 1), c.slice(1)
        # Nulls are keys like others: equal to each other, and to nothing else.
        same = pc.fill_null(pc.equal(above, here), False)
        same = pc.or_(same, pc.and_(above.is_null(), here.is_null()))
        changed = pc.invert(same) if changed is None else pc.or_(changed, pc.invert(same))
    return [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist())]


def list_digests(rows: DataFrame, keys: list[str], entry: Column | str, order: list[Column | str] | None = None,
                 distinct: bool = True, texts: dict[str, Column | str | Callable[[Column], Column]] | None = None, separator: str = ";",
                 combine: bool = True) -> DataFrame:
    """Per key: ``n`` entries and ``digest``, the SHA-256 of the compact JSON text of their list.

    Entries are in order of ``order``, by default their own. ``distinct`` counts equal rows once. Each of ``texts``
    becomes a column in which its values stand one after the other. Null entries and texts are left out, as
    aggregates of lists leave them out; a key without entries has no row. A text that is a function is made of
    the entry where its key is. A column that is named more than once moves once.

    Equal rows are folded before they move; where they are rare that only moves all rows once more, and
    ``combine=False`` folds them where their key is.
    """
    texts = texts or {}
    moved: dict[str, Column] = {}

    def carried(x: Column | str, name: str) -> str:
        if isinstance(x, str):
            name = f"_c_{x}"
        moved[name] = F.col(x) if isinstance(x, str) else x
        return name

    held = carried(entry, "_entry")
    by = [carried(x, f"_o{i}") for i, x in enumerate(order or [])] or [held]
    told = [x(F.col(held)) if callable(x) and not isinstance(x, Column) else F.col(carried(x, f"_t{i}")) for i, x in enumerate(texts.values())]
    work = rows.select(*keys, *(c.alias(name) for name, c in moved.items())).where(F.col(held).isNotNull())
    if distinct and combine:
        work = work.distinct()
    work = work.repartition(*keys)
    if distinct and not combine:
        work = work.distinct()
    # The text of an entry is made after the rows have moved and are sorted.
    work = work.sortWithinPartitions(*keys, *by)
    said = [f"_t{i}" for i in range(len(texts))]
    work = work.select(*keys, json_entry(F.col(held)).alias("_json"), *(c.cast("string").alias(x) for x, c in zip(said, told, strict=True)))
    schema = T.StructType([
        *(T.StructField(k, rows.select(k).schema[0].dataType) for k in keys), T.StructField("n", T.LongType()), T.StructField("digest", T.StringType()),
        *(T.StructField(name, T.StringType()) for name in texts)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # key, entries, hash, parts of each text
        done: list[list] = []

        def close() -> None:
            key, n, state, parts = now
            state.update(b"]")
            done.append([*key, n, state.hexdigest(), *(separator.join(p) for p in parts)])

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in target]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            done.clear()
            return out

        for batch in batches:
            starts = _starts(batch, keys)
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(batch)], strict=True)):
                key = [batch.column(k)[a].as_py() for k in keys]
                if now is None or i or key != now[0]:
                    if now is not None:
                        close()
                    now = [key, 0, hashlib.sha256(b"["), [[] for _ in said]]
                elif now[1]:
                    now[2].update(b",")
                now[2].update(",".join(batch.column("_json").slice(a, b - a).to_pylist()).encode())
                now[1] += b - a
                for parts, name in zip(now[3], said, strict=True):
                    parts += [x for x in batch.column(name).slice(a, b - a).to_pylist() if x is not None]
            if len(done) >= 5000:
                yield emit()
        if now is not None:
            close()
        yield emit()

    return work.mapInArrow(run, schema)

"""Prices as a Spark data source: partitions are ranges of tickers, and date and ticker filters reach the files.

    spark.dataSource.register(PriceSource)
    prices = spark.read.format("tidemark_prices").option("path", folder).option("splits", "F,M,T").load()

The folder holds Parquet files with (ticker, date, adj_close), in a store that pyarrow opens. `splits` are
the first tickers of all ranges but the first; without them there is one partition. Filters need the setting
PUSHDOWN; a session without it sets the option `pushdown` to false.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

PRICES = "ticker string, date date, adj_close double"
#: Session setting that lets Spark offer filters to data sources written in Python.
PUSHDOWN = ("spark.sql.python.filterPushdown.enabled", "true")
COMPARE = {
    EqualTo: lambda c, v: c == v, GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v,
    LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v, In: lambda c, v: c.isin(list(v)),
}


@dataclass
class TickerRange(InputPartition):
    """Tickers from `low` on and before `high`; None is open."""

    low: str | None
    high: str | None


class PlainReader(DataSourceReader):
    """Reads ranges of tickers whole."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.splits = sorted(s for s in options.get("splits", "").split(",") if s)
        self.conditions: list[tuple[str, str, object]] = []

    def partitions(self) -> list[TickerRange]:
        """Ranges that a pushed ticker condition leaves."""
        ends = [None, *self.splits, None]
        ranges = [TickerRange(a, b) for a, b in zip(ends, ends[1:], strict=False)]
        wanted = [v for c, name, v in self.conditions if c == "ticker" and name == "EqualTo"]
        return [r for r in ranges if all((r.low is None or r.low <= w) and (r.high is None or w < r.high) for w in wanted)] or ranges[:1]

    def read(self, partition: TickerRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        by_name = {kind.__name__: test for kind, test in COMPARE.items()}
        tests = [by_name[name](ds.field(c), value) for c, name, value in self.conditions]
        if partition.low is not None:
            tests.append(ds.field("ticker") >= partition.low)
        if partition.high is not None:
            tests.append(ds.field("ticker") < partition.high)
        where = None
        for test in tests:
            where = test if where is None else where & test
        table = ds.dataset(base, filesystem=system, format="parquet", exclude_invalid_files=False)
        for batch in table.to_batches(columns=["ticker", "date", "adj_close"], filter=where):
            if len(batch):
                yield batch.cast(pa.schema([("ticker", pa.string()), ("date", pa.date32()), ("adj_close", pa.float64())]))


class PriceReader(PlainReader):
    """Takes filters too; Spark asks for the setting PUSHDOWN then."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps comparisons of ticker and date with constants; Spark applies the others itself."""
        for f in filters:
            value = getattr(f, "value", None)
            simple = type(f) in COMPARE and f.attribute in (("ticker",), ("date",)) and all(
                isinstance(v, (str, dt.date)) for v in (value if isinstance(value, (tuple, list)) else [value]))
            if simple:
                self.conditions.append((f.attribute[0], type(f).__name__, value))
            else:
                yield f


class PriceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_prices"

    def schema(self) -> str:
        return PRICES

    def reader(self, schema) -> PlainReader:
        return PlainReader(self.options) if self.options.get("pushdown") == "false" else PriceReader(self.options)

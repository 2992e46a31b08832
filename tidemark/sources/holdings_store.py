"""Stored filings and positions, in folders by quarter under the caller's path.

What asks for a few quarters reads those: a constant range becomes a partition filter, and quarters that
come from chosen filings prune the scan when the query runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import holdings
from tidemark.sources.writers import write_holdings


@dataclass
class HoldingsStore:
    spark: SparkSession
    path: str

    def save(self, positions: DataFrame) -> None:
        """Adds positions and the totals of their filings; quarters that are in the data are replaced as a whole."""
        write_holdings(positions, f"{self.path}/positions")
        stored = self.spark.read.schema(positions.schema).parquet(f"{self.path}/positions")
        fresh = positions.select("report_date").distinct()
        write_holdings(holdings.filing_totals(stored.join(fresh, "report_date", "left_semi")), f"{self.path}/filings")

    def positions(self, first: Column | None = None, last: Column | None = None) -> DataFrame:
        return self._between("positions", first, last)

    def filings(self, first: Column | None = None, last: Column | None = None) -> DataFrame:
        return self._between("filings", first, last)

    def _between(self, name: str, first: Column | None, last: Column | None) -> DataFrame:
        out = self.spark.read.parquet(f"{self.path}/{name}")
        out = out if first is None else out.filter(F.col("report_date") >= first)
        return out if last is None else out.filter(F.col("report_date") <= last)

    def of(self, chosen: DataFrame) -> DataFrame:
        """Positions of the chosen filings (report_date, accession, and any other columns, which come along).
        The join is on the quarter too, so only folders of chosen quarters are read."""
        return self.positions().join(chosen, ["report_date", "accession"])

    def newest(self, n: int = 1) -> DataFrame:
        """Each fund's n newest resolved filings, with their neighbours in time."""
        chain = holdings.quarter_chain(holdings.resolve_filings(self.filings()))
        return holdings.latest_portfolios(chain, n)

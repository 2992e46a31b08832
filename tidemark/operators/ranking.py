"""Exact ranks and positions over groups of any size.

A window over a whole group would sort the group in one task. Here the rows are dealt out by ranges
of (group, keys) once, with as many ranges as the session has shuffle partitions. Rows are ranked
inside their range, and the weights of a group's lower ranges are added. Where the ranges are cut
only balances the work; it does not affect the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize


def weight_before(counts: DataFrame, group: Sequence[str], keys: Sequence[str], weight: str = "n") -> DataFrame:
    """Add ``before`` (weight of all smaller keys in the group) and ``total``.

    ``counts`` has one row per (group, keys). Keys are compared in the given order. The dealt rows
    are written once, so that ranks and range weights see the same ranges, also after a lost task.
    """
    g = list(group)
    dealt = materialize(
        counts.repartitionByRange(*g, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    lower = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*g, "_range").agg(F.sum(weight).alias("_w")).select(
        *g, "_range",
        F.coalesce(F.sum("_w").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_w").over(Window.partitionBy(*g)).alias("total"),
    )
    inside = Window.partitionBy(*g, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [*g, "_range"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )


def average_ranks(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(group, value) -> 1-based average rank of the value, its count, and the group total."""
    w = F.lit(1) if weight is None else F.col(weight)
    counts = df.groupBy(*group, value).agg(F.sum(w).alias("n"))
    return weight_before(counts, group, [value]).select(
        *group, value, "n", "total", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")
    )


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Zero-based position of every row in its group; ``order`` must be unique in a group."""
    return (
        weight_before(df.withColumn("n", F.lit(1)), group, order)
        .withColumnRenamed("before", "position")
        .drop("n")
    )

"""Connected components of a graph given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that reaches a smaller one; root is the smallest node reachable.

    Alternates two steps until nothing changes: every neighbour above a node is linked to the node's
    smallest neighbour, then every neighbour below it is. The links of a component shrink to a star
    in a number of rounds that grows with the logarithm of its size. Minima are combined before the
    shuffle, and the joins that hand them back are plain equi joins, which adaptive execution splits
    when one node has very many links. Each round is written to the shared folder.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    links = materialize(links, "links")

    def mark(rows: DataFrame) -> tuple[int, int]:
        row = rows.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        return row["n"], row["h"]

    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u")
        links = moved.select(F.col("u"), F.col("m").alias("v")).unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = materialize(links.where("u != v").distinct(), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""The corpus pipeline: filters and packs `documents` in stages, each written before the next reads it.

Every stage works on all rows that the one before has kept. All but the last return the columns of
documents. Rows with a null doc_id pass the stages that decide by doc_id; null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, packing, secret_scan, simhash, toxicity
from tidemark.session import materialize


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less those whose doc_id is in dropped, which is written first, so that Spark knows its size."""
    dropped = materialize(dropped.where("doc_id is not null").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic. It learns from the labels of three quarters of them."""
    verdicts = toxicity.judged(docs, common.read_table(spark, sf_dir, "labels"), holds=2, out_of=4)
    return without(docs, verdicts.where("predicted = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Near copies are those whose 64-bit fingerprints of five-word shingles differ in at most four bits, which
    stands for a similarity well above 0.9; most pairs between 0.8 and 0.9 are not linked.
    Of rows that repeat that doc_id one stays. Rows without a doc_id stay.
    """
    groups = simhash.near_duplicates(docs, words=5)
    kept = without(docs, groups.where("component_id != doc_id"))
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__repeated_id")), "repeated")
    marked = kept.join(repeated, F.col("doc_id") == F.col("__repeated_id"), "left")
    once = marked.where("__repeated_id is not null").drop("__repeated_id").dropDuplicates(["doc_id"])
    return marked.where("__repeated_id is null").drop("__repeated_id").unionByName(once).select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without(docs, decontaminate.contaminated(docs, common.read_table(spark, sf_dir, "benchmark")))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secret_scan.without_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that were kept, and the sequences they are packed into."""
    return packing.packed_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: SQL can't tokenise or fit the models of the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

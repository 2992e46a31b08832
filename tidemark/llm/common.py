"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark

#: Python worker processes tokenise side by side already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; a no-op where it was sent."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_sent", False):
        return
    root = os.path.dirname(os.path.abspath(tidemark.__file__))
    # The driver serves the file to the executors; only the driver reads this folder.
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-package-"), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for here, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    archive.write(full, os.path.join("tidemark", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tidemark_sent = True


def tidy(function: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For functions given to mapInArrow: when a task ends, memory that it has freed goes back to
    the system. Worker processes live on between tasks, and several share an executor's memory."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches, *args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def crc_of(column: str | Column) -> Column:
    """crc32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))

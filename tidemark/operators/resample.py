"""Bootstrap of a caller's metric, with no copy of a row per replicate.

A replicate gives each row a weight, as often as it is drawn: a Poisson number that follows from the row
and the replicate alone. So weights need no shuffle, a repeated task finds the same ones, and what a
task passes on is one sum vector per group and replicate, whatever the number of its rows. Sums are
merged by Spark, and the metric is read off them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows are numbered modulo this prime, so that products fit 64 bits.
PRIME = 2**31 - 1
#: Rows whose weights are held at once.
CHUNK = 2048


def poisson_steps(most: int = 9) -> list[int]:
    """A number below PRIME draws as many times as it reaches steps: one time in expectation."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * PRIME))
    return out


def replicate_factors(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each replicate: row x has the number (a x + b) mod PRIME."""
    part = lambda tag, r: int(hashlib.md5(f"{tag}|{seed}|{r}".encode()).hexdigest()[:7], 16)
    return np.array([1 + part("a", r) for r in range(samples)], np.int64), np.array([part("b", r) for r in range(samples)], np.int64)


def row_number(*key: str) -> Column:
    """A row's number, from the md5 of its key."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % PRIME


def resampled_sums(obs: DataFrame, group: Sequence[str], key: Sequence[str], terms: dict[str, Column], samples: int = 250, seed: int = 13) -> DataFrame:
    """(group, replicate, sums...): for each replicate the weighted sums of terms; replicate -1 is the data itself.

    ``key`` tells rows apart; rows that share it share their weights. Null terms count as zero."""
    names = list(terms)
    rows = obs.select(*group, row_number(*key).alias("_x"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in terms.items()))
    schema = T.StructType([*(rows.schema[g] for g in group), T.StructField("replicate", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    target = to_arrow_schema(schema)
    a, b = replicate_factors(samples, seed)
    steps = np.array(poisson_steps())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * len(batch)
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            which = np.array([number[k] for k in keys], np.int64)
            x = batch.column("_x").to_numpy()
            values = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            for k, i in number.items():
                own = np.flatnonzero(which == i)
                total = sums.setdefault(k, np.zeros((samples + 1, len(names))))
                for at in range(0, len(own), CHUNK):
                    some = own[at : at + CHUNK]
                    weights = np.searchsorted(steps, (x[some, None] * a + b) % PRIME, side="right")
                    total[:-1] += weights.T @ values[some]
                    total[-1] += values[some].sum(axis=0)
            if len(sums) > 1000:  # many small groups: pass on what there is, and start anew
                yield emit(sums)
                sums = {}
        yield emit(sums)

    def emit(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        keys = [k for k in sums for _ in range(samples + 1)]
        columns = [pa.array([k[i] for k in keys], target.field(i).type) for i in range(len(group))]
        columns.append(pa.array([*range(samples), -1] * len(sums), pa.int32()))
        table = np.concatenate(list(sums.values())) if sums else np.zeros((0, len(names)))
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(table[:, j]) for j in range(len(names)))], schema=target)

    return rows.mapInArrow(partial, schema).groupBy(*group, "replicate").agg(*(F.sum(n).alias(n) for n in names))


def metric_interval(obs: DataFrame, group: Sequence[str], key: Sequence[str], terms: dict[str, Column], metric: Callable[[dict[str, Column]], Column],
                    samples: int = 250, seed: int = 13) -> DataFrame:
    """Per group the caller's metric of the data, and its 95 % interval over replicates. ``metric`` gets the
    sums by name and returns an expression; null values of it are left out."""
    sums = resampled_sums(obs, group, key, terms, samples, seed)
    values = sums.select(*group, "replicate", metric({n: F.col(n) for n in terms}).alias("v"))
    drawn = F.when((F.col("replicate") >= 0) & F.col("v").isNotNull(), F.col("v"))
    ordered = F.sort_array(F.collect_list(drawn))  # one number per replicate
    pick = lambda p: F.round(F.get(ordered, F.floor(p * (F.size(ordered) - 1)).cast("int")), 6)
    return values.groupBy(*group).agg(
        F.round(F.max(F.when(F.col("replicate") == -1, F.col("v"))), 6).alias("value"), pick(0.025).alias("lo"), pick(0.975).alias("hi"))


def correlation_terms(x: Column, y: Column) -> dict[str, Column]:
    """What a correlation is made of."""
    return {"w": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}


def correlation(s: dict[str, Column]) -> Column:
    """Pearson's correlation from weighted sums; null without variance."""
    cov = s["xy"] * s["w"] - s["x"] * s["y"]
    var = (s["xx"] * s["w"] - s["x"] * s["x"]) * (s["yy"] * s["w"] - s["y"] * s["y"])
    return F.when(var > 1e-12, cov / F.sqrt(var))

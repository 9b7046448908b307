"""Sufficient statistics of all vectors in one pass: mergeable, and bounded by the dimension."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups into which the tasks' sums are added up first, so that no task adds all of them.
GROUPS = 64
#: Bytes of input that come in few tasks.
SMALL = 64 << 20


@dataclass
class Moments:
    """n, sums of x, of x x', of lengths and of squared lengths."""

    n: int
    total: np.ndarray
    gram: np.ndarray
    lengths: float
    squares: float

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.gram + other.gram, self.lengths + other.lengths, self.squares + other.squares)

    @property
    def dim(self) -> int:
        return len(self.total)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def cov(self) -> np.ndarray:
        """Of a sample (n - 1)."""
        return (self.gram - np.outer(self.total, self.total) / self.n) / max(1, self.n - 1)

    @property
    def norm_mean(self) -> float:
        return self.lengths / self.n

    @property
    def norm_sd(self) -> float:
        return float(np.sqrt(max(0.0, self.squares / self.n - self.norm_mean**2)))


def partial(rows: DataFrame) -> DataFrame:
    """(part, g, values) whose values add up by part: a Gram row for each dimension, and one row of sums.

    Each task sums its own rows; g is the group in which its sums are added up first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram, lengths, squares = 0, 0.0, 0.0, 0.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            n += len(x)
            total, gram = total + x.sum(axis=0), gram + x.T @ x
            s = np.einsum("ij,ij->i", x, x)
            lengths, squares = lengths + np.sqrt(s).sum(), squares + s.sum()
        if n:
            rows = [np.concatenate([[n, lengths, squares], total]), *gram]
            g = pa.array([TaskContext.get().partitionId() % GROUPS] * len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(rows) - 1), pa.int32()), g, pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["part", "g", "values"])

    return rows.select("vec").mapInArrow(run, "part int, g int, values array<double>")


def combined(partials: DataFrame) -> DataFrame:
    """(part, g, values), at most one row for each part and group."""
    add = lambda x: pd.DataFrame({"part": x["part"].iloc[:1], "g": x["g"].iloc[:1], "values": [np.sum(np.stack(x["values"]), axis=0).tolist()]})
    return partials.groupBy("part", "g").applyInPandas(add, "part int, g int, values array<double>")


def collected(partials: DataFrame, small: bool = False) -> Moments:
    """To the driver: dim + 1 rows; small: as many for each of a few tasks."""
    by = partials if small else combined(combined(partials).withColumn("g", F.lit(0)))
    rows: dict[int, np.ndarray] = {}
    for r in by.collect():
        rows[r["part"]] = rows.get(r["part"], 0.0) + np.array(r["values"])
    if -1 not in rows:
        raise ValueError("there are no rows")
    head = rows.pop(-1)
    return Moments(int(head[0]), head[3:], np.stack([rows[i] for i in range(len(rows))]), head[1], head[2])


def moments(rows: DataFrame) -> Moments:
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return collected(partial(rows), int(size.toString() if hasattr(size, "toString") else size) <= SMALL)

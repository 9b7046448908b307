"""Operator 9: packing documents into sequences by cutting-stock column generation.

A document's ids, closed by id 1, are cut into whole sequences and one rest. Rests are counted by
length class (multiples of `unit`, upwards): the histogram is all that reaches the driver. A
linear program over patterns of classes is solved by column generation (a knapsack prices
columns), rounded down, and completed by first fit decreasing. Documents are ranked in their
class, and ranks map to sequences and slots by the patterns' ranges.

Defined results: a null or empty text is its closing id alone. Repeated rows and null doc_ids
are packed like others. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, number, read, small_batches
from .cutting import plan
from .tokens import tokenizer_path, piece_ids

LENGTH, END, UNIT = 2048, 1, 8


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document cut at multiples of length."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    close = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_ids(path)
        for b in batches:
            at, start, size, crc, total = [], [], [], [], []
            for i, own in enumerate(tokens.packed([x or b"" for x in b.column(1).to_pylist()])):
                ids = memoryview(own.astype("<u4").tobytes() + close)
                n = len(ids) // 4
                for s in range(0, n, length):
                    e = min(n, s + length)
                    at.append(i), start.append(s), size.append(e - s), total.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            longs = [pa.array(np.array(x, np.int64)) for x in (start, size, crc, total)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *longs], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def ranges(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """class -> rows (first rank, count in a sequence, first sequence, first slot), by rank."""
    out: dict[int, list] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        slot = 0
        for c, k in sorted(pattern.items(), reverse=True):
            rank = next_rank.get(c, 0)
            out.setdefault(c, []).append((rank, k, sequence, slot))
            next_rank[c] = rank + k * times
            slot += k
        sequence += times
    return {c: np.array(rows, np.int64) for c, rows in out.items()}


def assign(ranked: DataFrame, places: dict[int, np.ndarray]) -> DataFrame:
    """ranked (class, rank, ...) with sequence_id and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, rank = b.column("class").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for one in np.unique(c):
                own = c == one
                rows = places[int(one)]
                r = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                sequence[own] = r[:, 2] + (rank[own] - r[:, 0]) // r[:, 1]
                slot[own] = r[:, 3] + (rank[own] - r[:, 0]) % r[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], names=[*b.schema.names, "sequence_id", "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, slot bigint")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, unit: int = UNIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset, the piece's place in its sequence."""
    cut = pieces(docs, path or tokenizer_path(), length, end, key, text)
    rows = materialize(cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int")))
    demand = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}  # at most length / unit rows
    patterns = plan(demand, -(-length // unit))
    placed = assign(number(rows, ["class"], [key, "start", "ids_crc32"], "rank"), ranges(patterns))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")))
    return out.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))

"""All pairs of rows: a block of one side stays in a task, the other side passes it by from files.

The right side is written once to the folder that all executors share, and every task reads it in
batches past its block of left rows. So what is shuffled and written grows with the rows and with
what is kept of them, not with their pairs; a task holds a bounded block, one batch and one tile of
cosines, however many rows there are. The work is quadratic by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import files, opened

#: Right rows of a tile of cosines, and left ones: a tile stays in a core's cache.
BLOCK, TILE = 1024, 128
#: Left rows of a task's block at most, bytes of their vectors, and neighbours that are kept for them all.
LEFT, BYTES, KEPT = 8192, 1 << 25, 1 << 20
#: Blocks of a table that meets itself: what they add to each other's sums grows with their number.
PARTS = 96


def _plain(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """A batch's columns; arrays as the rows of a matrix."""
    column = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else c.to_numpy(zero_copy_only=False)
    return {n: column(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _blocks(batches: Iterator[dict], most: int) -> Iterator[dict]:
    """Rows in blocks of at most `most` rows and BYTES of vectors."""
    held: list[dict] = []
    for b in batches:
        while len(b["vec"]):
            fit = max(1, min(most, BYTES // (8 * b["vec"].shape[1] or 1)))
            free = fit - sum(len(h["vec"]) for h in held)
            held.append({n: c[:free] for n, c in b.items()})
            b = {n: c[free:] for n, c in b.items()}
            if sum(len(h["vec"]) for h in held) >= fit:
                yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _read(name: str, block: int) -> Iterator[dict]:
    from pyarrow.parquet import ParquetFile

    with opened(name) as f:
        yield from (_plain(b) for b in ParquetFile(f).iter_batches(4 * block) if len(b))


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) at which two columns are equal."""
    met = pd.DataFrame({"k": a, "i": np.arange(len(a))}).merge(pd.DataFrame({"k": b, "j": np.arange(len(b))}), on="k")
    return met["i"].to_numpy(), met["j"].to_numpy()


def _tiles(x: dict, y: dict, block: int, itself: bool = False, key: str = "id") -> Iterator[tuple]:
    """(s, t, c, i, j): tiles of the product of x's rows from s and y's from t, and where in it both have one id."""
    i, j = (np.array([], int),) * 2 if itself else _same(x[key], y["id"])
    p, q = x["vec"], y["vec"]
    tile = min(TILE, block)
    room = np.empty((min(tile, len(p)), min(block, len(q))))
    for t in range(0, len(q), block):
        other = q[t : t + block].T
        here = (j >= t) & (j < t + block)
        for s in range(0, len(p), tile):
            c = room[: min(tile, len(p) - s), : other.shape[1]]
            c = np.matmul(p[s : s + tile], other, out=c if c.flags.c_contiguous else None)
            at = here & (i >= s) & (i < s + tile)
            yield s, t, c, i[at] - s, j[at] - t


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def _out(columns: dict, schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for a in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][a : a + rows], f.type) for f in schema], schema=schema)


def _tasks(rows: DataFrame) -> int:
    """Four tasks a core, but none of a few rows."""
    return max(1, min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 256)))


def scan(left: DataFrame, right: DataFrame, reducer: Callable, schema: str, block: int = BLOCK, most: int = LEFT, itself: bool = False, key: str = "id") -> DataFrame:
    """What reducer makes of every block of left rows and all right ones; rows are (id, vec, ...) at unit length.

    reducer(x) has meet(y, s, t, c, i, j), that takes a tile of cosines (see _tiles()) and may overwrite it, and
    end(); both return columns of the given schema, or None.
    """
    names, types = files(right), _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks((_plain(b) for b in batches if len(b)), most if block >= TILE else block):
            r = reducer(x)
            for name in names:
                for y in _read(name, block):
                    for s, t, c, i, j in _tiles(x, y, block, itself, key):
                        got = r.meet(y, s, t, c, i, j)
                        if got is not None:
                            yield from _out(got, types)
            got = r.end()
            if got is not None:
                yield from _out(got, types)

    return left.repartition(_tasks(left)).mapInArrow(run, schema)


def _ids(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def repeated(rows: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


class _Best:
    """The k best of the right rows for each of a block's rows; ties by id."""

    def __init__(self, x: dict, k: int, euclidean: bool):
        self.x, self.k, self.euclidean = x, k, euclidean
        self.length = (x["vec"] ** 2).sum(axis=1)
        self.edge = np.full(len(x["id"]), -np.inf)
        self.parts: list[tuple] = []
        self.new = 0

    def meet(self, y: dict, s: int, t: int, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        rows, columns = c.shape
        p, q = self.x["vec"][s : s + rows], y["vec"][t : t + columns]
        slack = np.full(rows, 1e-12)
        if self.euclidean:  # by squares, negated
            own, other = self.length[s : s + rows], (q * q).sum(axis=1)
            slack = 1e-12 * (own + other.max())
            c *= 2
            c -= own[:, None]
            c -= other
        c[i, j] = -np.inf
        edge = self.edge[s : s + rows]
        if self.k < columns and np.isneginf(edge).any():
            edge = np.maximum(edge, np.partition(c, -self.k, axis=1)[:, -self.k])
        at, to = np.divmod(np.flatnonzero(c >= (edge - slack)[:, None]), columns)
        real = c[at, to] > -np.inf
        at, to = at[real], to[real]
        # equal vectors have one value wherever they stand in a tile, so that ids settle ties
        for a in range(0, len(at), 1 << 15):
            u, v = p[at[a : a + (1 << 15)]], q[to[a : a + (1 << 15)]]
            value = -((u - v) ** 2).sum(axis=1) if self.euclidean else np.einsum("ij,ij->i", u, v)
            self.parts.append((at[a : a + (1 << 15)] + s, y["id"][t + to[a : a + (1 << 15)]], value))
        self.new += len(at)
        if self.new >= max(len(self.edge) * self.k, 1 << 14):
            self.merge()

    def merge(self) -> np.ndarray:
        """Drop what is not among the k best; returns the ranks of the others, from 0."""
        at, to, value = (np.concatenate(z) for z in zip(*self.parts, strict=True)) if self.parts else (np.array([], int), self.x["id"][:0], np.array([]))
        order = np.lexsort((to, -value, at))
        at, to, value = at[order], to[order], value[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, to, value, rank = (z[rank < self.k] for z in (at, to, value, rank))
        full = rank == self.k - 1
        self.edge[at[full]] = value[full]
        self.parts, self.new = [(at, to, value)], 0
        return rank

    def end(self) -> dict:
        rank = self.merge()
        at, to, value = self.parts[0]
        return {"src": self.x["id"][at], "dst": to, "cos": -np.sqrt(-value) if self.euclidean else value, "rank": (rank + 1).astype(np.int32)}


def top_k(left: DataFrame, right: DataFrame, k: int, euclidean: bool = False, block: int = BLOCK) -> DataFrame:
    """(src, dst, cos, rank): the k rows of right nearest each row of left, itself not counted; ties by id.

    euclidean: by distance between the vectors as given, in cos' place negated.
    """
    left, right = left.select("id", "vec"), right.select("id", "vec")
    near = scan(left, right, lambda x: _Best(x, k, euclidean), f"src {_ids(left)}, dst {_ids(right)}, cos double, rank int", block, max(64, min(LEFT, KEPT // k)))
    if not repeated(left):
        return near
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("cos").desc(), "dst"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


class _Sums:
    def __init__(self, x: dict, of: Callable, by: str | None):
        self.x, self.of, self.by = x, of, by
        self.sums: dict = {}

    def meet(self, y: dict, s: int, t: int, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        n = np.full(len(c), c.shape[1]) if self.by is None else None
        value = self.of(c)
        value[i, j] = 0
        if self.by is None:
            self.add(None, s, value.sum(axis=1), n - np.bincount(i, minlength=len(c)))
            return
        for name, at in pd.Series(y[self.by][t : t + c.shape[1]]).groupby(y[self.by][t : t + c.shape[1]]).indices.items():
            self.add(name, s, value[:, at].sum(axis=1), len(at) - np.bincount(i[np.isin(j, at)], minlength=len(c)))

    def add(self, name: object, s: int, total: np.ndarray, n: np.ndarray) -> None:
        if name not in self.sums:
            self.sums[name] = np.zeros(len(self.x["id"])), np.zeros(len(self.x["id"]), np.int64)
        for mine, more in zip(self.sums[name], (total, n), strict=True):
            mine[s : s + len(more)] += more

    def end(self) -> dict | None:
        if not self.sums:
            return None
        own = {"id": np.concatenate([self.x["id"]] * len(self.sums)), **{c: np.concatenate([v[k] for v in self.sums.values()]) for k, c in enumerate(("total", "n"))}}
        return own if self.by is None else own | {self.by: np.repeat(np.array(list(self.sums)), len(self.x["id"]))}


def sums(left: DataFrame, right: DataFrame, of: Callable[[np.ndarray], np.ndarray], by: str | None = None, block: int = BLOCK, itself: bool = False) -> DataFrame:
    """(id[, by], total, n): the sum of of(cosines) of each row of left over right, itself not counted unless told so.

    of: may overwrite its argument, a tile. A table that meets itself is summed by half its pairs.
    """
    kind = _ids(left)
    extra = f", {by} {right.schema[by].dataType.simpleString()}" if by else ""
    keys = ["id"] + ([by] if by else [])
    if left is right and by is None and not itself:
        got = _own_sums(left.select("id", "vec"), of, block)
    else:
        right = right.select("id", "vec", *([by] if by else []))
        got = scan(left.select("id", "vec"), right, lambda x: _Sums(x, of, by), f"id {kind}{extra}, total double, n bigint", block, itself=itself)
    return got.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def halves(parts: int, own: int) -> list[int]:
    """The parts that part `own` meets, itself first, so that every two parts meet once and all have the same work."""
    far = parts // 2
    return [(own + k) % parts for k in range(far + 1) if 2 * k < parts or k == 0 or own < far]


def by_halves(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(own file, files to meet) of every file of a table, each pair of files once; yields columns of the schema."""
    names, types = files(rows.repartition(min(PARTS, _tasks(rows)))), _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column(0).to_pylist():
                for got in work(names[own], [names[k] for k in halves(len(names), own)]):
                    yield from _out(got, types)

    return rows.sparkSession.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, schema)


def _own_sums(rows: DataFrame, of: Callable, block: int) -> DataFrame:
    """sums() of a table over itself: a tile of two blocks adds to the sums of both."""

    def work(own: str, others: list[str]) -> Iterator[dict]:
        ids: dict[str, np.ndarray] = {}
        total: dict[str, np.ndarray] = {}
        count: dict[str, np.ndarray] = {}
        for name in others:
            ids[name] = np.concatenate([y["id"] for y in _read(name, block)] or [[]])
            total[name], count[name] = np.zeros(len(ids[name])), np.zeros(len(ids[name]), np.int64)
        a = 0
        for x in _blocks(_read(own, block), LEFT):
            for name in others:
                b = 0
                for y in _read(name, block):
                    for s, t, c, i, j in _tiles(x, y, block):
                        rows, columns = c.shape
                        value = of(c)
                        value[i, j] = 0
                        total[own][a + s : a + s + rows] += value.sum(axis=1)
                        count[own][a + s : a + s + rows] += columns - np.bincount(i, minlength=rows)
                        if name != own:
                            total[name][b + t : b + t + columns] += value.sum(axis=0)
                            count[name][b + t : b + t + columns] += rows - np.bincount(j, minlength=columns)
                    b += len(y["id"])
            a += len(x["id"])
        for name in others:
            yield {"id": ids[name], "total": total[name], "n": count[name]}

    return by_halves(rows, work, f"id {_ids(rows)}, total double, n bigint")


class _Counts:
    def __init__(self, x: dict):
        self.x, self.n = x, np.zeros(len(x["id"]), np.int64)

    def meet(self, y: dict, s: int, t: int, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        c[i, j] = -np.inf
        self.n[s : s + len(c)] += (c > self.x["above"][s : s + len(c), None]).sum(axis=1)

    def end(self) -> dict:
        return {"id": self.x["id"], "n": self.n}


def counts_above(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, n): for each row (id, vec, above) of left the rows of right, itself not counted, whose cosine is greater than `above`."""
    return scan(left.select("id", "vec", "above"), right.select("id", "vec"), _Counts, f"id {_ids(left)}, n bigint", block).groupBy("id").agg(F.sum("n").alias("n"))


class _Over:
    def __init__(self, x: dict, cosine: float):
        self.x, self.cosine = x, cosine

    def meet(self, y: dict, s: int, t: int, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict | None:
        at, to = np.divmod(np.flatnonzero(c >= self.cosine), c.shape[1])
        a, b, cos = self.x["id"][s + at], y["id"][t + to], c[at, to]
        up = a < b
        return {"a": a[up], "b": b[up], "cos": cos[up]} if up.any() else None

    def end(self) -> None:
        return None


def at_least(rows: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(a, b, cos), a < b: the pairs of that cosine or more."""
    kind = _ids(rows)
    slim = rows.select("id", "vec")
    return scan(slim, slim, lambda x: _Over(x, cosine), f"a {kind}, b {kind}, cos double", block, itself=True)

"""Operator 4: near-duplicate embeddings by hashing to the E8 lattice.

Each table projects unit vectors by a random orthonormal map to one or more blocks of eight
dimensions, scales them and decodes the nearest E8 lattice point of each block: together they are the
vector's cell. A vector is stored in its own cell and also looks into those neighbouring cells
whose border lies within `reach` in every block. Pairs that meet, with equal labels, are verified by
cosine in double precision. Equal vectors are one node: copies never multiply the work, and their
links are counted by weight. More vectors get more blocks (smaller cells) and tables; every setting
misses a pair at the threshold with a chance of about one in a million.

Recall is that of the hashing, over all rows; precision is exact. Defined results:
vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing and are their own component, kept. Vectors of different lengths never
link. Repeated rows each count; where vec_id repeats, the rows share their component. Ties have
no effect. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read
from .components import components

COSINE, SEED = 0.98, 20


@dataclass(frozen=True)
class Setting:
    """blocks of eight dimensions in a table; keys: cells stored and probed for a vector in all tables; met: the share of all vectors it then meets by chance."""

    blocks: int
    tables: int
    scale: float
    reach: float
    keys: float
    met: float


#: As measured on random vectors. At cosine 0.98 a table finds 0.79, 0.64, 0.69 and 0.50 of pairs (the first more with its reach).
SETTINGS = (Setting(1, 6, 8.0, 0.25, 67, 1.7e-3), Setting(2, 14, 5.0, 0.05, 41, 1.9e-5), Setting(3, 12, 4.0, 0.05, 62, 6.7e-7), Setting(4, 20, 3.5, 0.03, 77, 5e-8))
#: What a key costs, in vectors met.
KEY_COST = 10


def setting_for(n: int, dim: int) -> Setting:
    """The cheapest setting for n vectors among those whose blocks fit into the dimensions."""
    fit = [s for s in SETTINGS if 8 * s.blocks <= max(8, dim)]
    return min(fit, key=lambda s: KEY_COST * s.keys + s.met * n)


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row, doubled, so that its coordinates are integers."""

    def d8(x: np.ndarray) -> np.ndarray:
        r = np.rint(x)
        odd = (r.sum(axis=1) % 2).astype(bool)
        off = x - r
        worst = np.abs(off).argmax(axis=1)
        row = np.flatnonzero(odd)
        r[row, worst[row]] += np.where(off[row, worst[row]] >= 0, 1, -1)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def shortest() -> np.ndarray:
    """The 240 shortest vectors, doubled."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out, np.int64)


def projections(dim: int, tables: int, blocks: int, seed: int = SEED) -> np.ndarray:
    """(tables, blocks, 8, dim): orthonormal rows, zero-padded below eight dimensions."""
    random = np.random.default_rng([seed, dim])
    out = np.zeros((tables, 8 * blocks, dim))
    for t in range(tables):
        q, _ = np.linalg.qr(random.standard_normal((dim, min(8 * blocks, dim))))
        out[t, : q.shape[1]] = q.T * np.sqrt(dim / 64)  # the spread of a projected pair doesn't depend on dim
    return out.reshape(tables, blocks, 8, dim)


def pack(points: np.ndarray) -> np.ndarray:
    """One long of eight coordinates, a byte each."""
    return (points & 0xFF).astype(np.uint8).view(np.uint64).reshape(-1)


def joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a block's cell after the hash of those before; cells that share one only bring more pairs together."""
    x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ more
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cells(unit: np.ndarray, projection: np.ndarray, scale: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cells, probe): every row's own cell, and those of the neighbours to probe, in all blocks of a table.

    Either vector of a pair may probe the other's cell: it is found if one is near enough to the border.
    """
    rows, cell, probe = np.arange(len(unit)), np.ones(len(unit), np.uint64), np.zeros(len(unit), bool)
    near = shortest()
    for p in projection:
        y = unit @ p.T * scale
        own = decode(y)
        along = (y - own / 2) @ near.T / 2
        at, which = np.nonzero((1 - along) / np.sqrt(2) <= reach)
        # a row's choices: its own point, then its neighbours
        count = 1 + np.bincount(at, minlength=len(unit))
        start = np.cumsum(count) - count
        choice = np.empty(count.sum(), np.uint64)
        choice[start] = pack(own)
        place = start[at] + 1 + np.arange(len(at)) - np.searchsorted(at, at)
        choice[place] = pack(own[at] + near[which])
        times = count[rows]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows, cell, probe = np.repeat(rows, times), np.repeat(cell, times), np.repeat(probe, times) | (k > 0)
        cell = joined(cell, choice[start[rows] + k])
    return rows, cell.view(np.int64), probe


def hashed(vectors: DataFrame, n: int) -> DataFrame:
    """(node, label, t, cell, probe) of n vectors (node, label, vector): stored cells and probes."""
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("vector")).to_numpy()
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                x = part.column("vector").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                s = setting_for(n, int(dim))
                for t, p in enumerate(projections(int(dim), s.tables, s.blocks)):
                    rows, cell, probe = cells(unit, p, s.scale, s.reach)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part.column("node").take(at), part.column("label").take(at), pa.array(np.full(len(rows), t, np.int32)), pa.array(cell), pa.array(probe)], names=["node", "label", "t", "cell", "probe"])

    return vectors.mapInArrow(run, f"node bigint, label {kind}, t int, cell bigint, probe boolean")


def links(vectors: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """(a, b), a < b: nodes of one label whose cosine is `cosine` or more, found by the tables."""
    keys = materialize(hashed(vectors, n))
    left = keys.select(F.col("node").alias("x"), "label", "t", "cell", F.col("probe").alias("p"))
    right = keys.where("NOT probe").select(F.col("node").alias("y"), "label", "t", "cell")
    met = left.join(right, ["label", "t", "cell"]).where((F.col("x") != F.col("y")) & (F.col("p") | (F.col("x") < F.col("y"))))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    va = vectors.select(F.col("node").alias("a"), F.col("vector").alias("va"))
    vb = vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb"))

    @F.pandas_udf("double")
    def cos(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), -1.0)
        sx, sy = x.map(len).to_numpy(), y.map(len).to_numpy()
        for dim in np.unique(sx[sx == sy]):
            own = np.flatnonzero((sx == dim) & (sy == dim))
            p, q = (np.stack(z.iloc[own].to_list()).astype(np.float64) for z in (x, y))
            p, q = (z / np.abs(z).max(axis=1, keepdims=True) for z in (p, q))
            out[own] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
        return pd.Series(out)

    return pairs.join(va, "a").join(vb, "b").where(cos("va", "vb") >= cosine).select("a", "b")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    usable = v.isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x.cast("double") != 0)
    # equal labels and equal vectors (-0.0 as 0.0) are one node
    plain = F.transform(v, lambda x: F.when(x.cast("double") == 0, F.lit(0.0)).otherwise(x.cast("double")))
    same = F.unhex(F.sha2(F.to_json(F.struct(F.col(label).alias("l"), plain.alias("v"))), 256))
    kept = materialize(rows.select(key, F.coalesce(usable, F.lit(False)).alias("ok"), F.when(F.coalesce(usable, F.lit(False)), same).alias("same"), F.col(label).alias("label"), plain.alias("vector")))
    nodes = kept.where("ok").groupBy("same").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("same")))
    found = materialize(links(nodes.select("node", "label", "vector"), nodes.count(), cosine))
    slim = nodes.select("node", "same", "least", "n")
    both = found.union(found.select("b", "a")).toDF("node", "other")
    weights = both.join(slim.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("linked"))
    roots = components(found)
    named = slim.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(weights, "node", "left")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("same", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"))
    out = kept.select(key, "same").join(names, "same", "left")
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


OP4_SQL = """
WITH RECURSIVE e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS l FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
g AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND a.label = b.label AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.98),
r(id, root) AS (SELECT id, id FROM e UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM g GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM c LEFT JOIN n USING (id)
"""


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))

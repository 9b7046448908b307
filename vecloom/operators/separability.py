"""How far apart the labelled groups of vectors lie. Integer label -1 is noise and left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric, vec
from .pairs import repeated, scan, sums


def labelled(rows: DataFrame) -> DataFrame:
    kept = rows.where(F.col("label").isNotNull())
    return kept.where(F.col("label") != -1) if isinstance(rows.schema["label"].dataType, T.IntegralType) else kept


def group_sums(rows: DataFrame) -> DataFrame:
    """(label, n, s, q): rows, sums and sums of squares by dimension of each group; added up in every task before the shuffle."""
    own = labelled(rows).select("label", "vec")
    kind = own.schema["label"].dataType.simpleString()

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": x["label"].iloc[:1], "n": [x["n"].sum()], "s": [np.sum(np.stack(x["s"]), axis=0)], "q": [np.sum(np.stack(x["q"]), axis=0)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for name, at in b.groupby("label").indices.items():
                x = np.stack(b["vec"].iloc[at].to_list())
                n, s, q = total.get(name, (0, 0.0, 0.0))
                total[name] = (n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0))
        if total:
            yield pd.DataFrame({"label": list(total), "n": [t[0] for t in total.values()], "s": [t[1] for t in total.values()], "q": [t[2] for t in total.values()]})

    schema = f"label {kind}, n bigint, s array<double>, q array<double>"
    return own.mapInPandas(run, schema).groupBy("label").applyInPandas(add, schema)


def centroids(rows: DataFrame) -> DataFrame:
    """(label, n, pos, mean, part): mean by dimension, and the same at unit length."""
    mean = F.transform("s", lambda x: x / F.col("n"))
    sums = group_sums(rows).select("label", "n", mean.alias("mean")).withColumn("_l", F.greatest(vec.norm(F.col("mean")), F.lit(1e-12)))
    return sums.select("label", "n", "_l", F.posexplode("mean").alias("pos", "mean")).select("label", "n", "pos", "mean", (F.col("mean") / F.col("_l")).alias("part"))


def centroid_cosines(rows: DataFrame) -> DataFrame:
    """(g1, g2, cos) of every two groups' centroids."""
    own = group_sums(rows).select("label", vec.unit(F.transform("s", lambda x: x / F.col("n"))).alias("c"))
    a, b = own.select(F.col("label").alias("g1"), F.col("c").alias("p")), own.select(F.col("label").alias("g2"), F.col("c").alias("q"))
    # one row a group on either side; the result has one for each two groups
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").select("g1", "g2", vec.dot(F.col("p"), F.col("q")).alias("cos"))


def fisher(rows: DataFrame) -> DataFrame:
    """One row: between-group over within-group scatter, by traces; 0 without any within."""
    long = group_sums(rows).select("n", F.posexplode(F.arrays_zip("s", "q")).alias("pos", "z")).select("n", "pos", "z.s", "z.q")
    total = long.groupBy("pos").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    out = total.agg(F.sum(F.col("B") - F.col("S") * F.col("S") / F.col("N")).alias("between"), F.sum(F.col("Q") - F.col("B")).alias("within"))
    return out.withColumn("fisher", F.when(F.col("within") > 0, F.col("between") / F.col("within")).otherwise(0.0))


def largest_groups(labels: DataFrame, most: int, least_prefix: int = 6) -> DataFrame:
    """(label, n): the `most` largest groups of text labels, without the beginning that all labels share if it has `least_prefix` characters."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ends = n.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    shared = 0
    for p, q in zip(ends["a"] or "", ends["b"] or "", strict=False):
        if p != q:
            break
        shared += 1
    name = F.expr(f"substring(label, {shared + 1})") if shared >= least_prefix else F.col("label")
    return n.select(name.alias("label"), "n").orderBy(F.col("n").desc(), "label").limit(most)


def silhouette(rows: DataFrame) -> DataFrame:
    """(id, label, silhouette) by cosine distance; a group of one row has 0."""
    own = labelled(rows)
    if not repeated(own):
        return _silhouette(own)
    dist = sums(own, own, lambda c: 1 - c, by="label").withColumnRenamed("label", "g")
    mean = dist.where("n > 0").withColumn("d", F.col("total") / F.col("n")).join(own.select("id", "label"), "id")
    ab = mean.groupBy("id", "label").agg(F.max(F.when(F.col("g") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("g") != F.col("label"), F.col("d"))).alias("b"))
    return ab.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))).alias("silhouette"))


class _Apart:
    """Mean cosine distance of each of a block's rows to its own group, itself not counted, and to the nearest other."""

    def __init__(self, x: dict):
        self.x = x
        self.own, self.other = np.full(len(x["id"]), np.nan), np.full(len(x["id"]), np.inf)

    def meet(self, y: dict, s: int, t: int, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        n = y["n"][t : t + c.shape[1]]
        d = n - c
        p = self.x["vec"][s + i]
        alone = n[j] < 2
        self.own[s + i] = np.where(alone, np.nan, (d[i, j] - 1 + (p * p).sum(axis=1)) / np.maximum(n[j] - 1, 1))
        d /= n
        d[i, j] = np.inf
        np.minimum(self.other[s : s + len(c)], d.min(axis=1), out=self.other[s : s + len(c)])

    def end(self) -> dict:
        a, b = self.own, self.other
        told = ~np.isnan(a) & np.isfinite(b)
        value = np.zeros(len(a))
        value[told] = (b[told] - a[told]) / np.maximum(np.maximum(a[told], b[told]), 1e-12)
        return {"id": self.x["id"], "label": self.x["label"], "silhouette": value}


def _silhouette(own: DataFrame) -> DataFrame:
    """silhouette() where no id stands twice: a row's distances to a group add up to the group's size less its product with the group's sum."""
    groups = group_sums(own).select(F.col("label").alias("id"), "n", F.col("s").alias("vec"))
    kind = [own.schema[c].dataType.simpleString() for c in ("id", "label")]
    return scan(own.select("id", "label", "vec"), groups, _Apart, f"id {kind[0]}, label {kind[1]}, silhouette double", key="label")


def within_between(pairs: DataFrame) -> DataFrame:
    """(same, n, mean, sd) of sampled pair cosines (la, lb, cos)."""
    known = pairs.where(F.col("la").isNotNull() & F.col("lb").isNotNull())
    return known.groupBy((F.col("la") == F.col("lb")).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("sd"))


def by_label(rows: DataFrame, purity: DataFrame) -> DataFrame:
    """(label, n, intra, purity, nearest, nearest_cos): within-group cosine, and the nearest other centroid."""
    from pyspark.sql.window import Window

    own = labelled(rows)
    if repeated(own):
        pair = sums(own, own, lambda c: c, by="label").withColumnRenamed("label", "g").join(own.select("id", "label"), "id").where("g = label")
        intra = pair.groupBy("label").agg((F.sum("total") / F.sum("n")).alias("intra"))
    else:  # the cosines of all pairs of a group add up to its sum's square less its rows' squares
        square = vec.dot(F.col("s"), F.col("s")) - F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
        intra = group_sums(own).where("n > 1").select("label", (square / (F.col("n") * (F.col("n") - 1))).alias("intra"))
    other = centroid_cosines(rows).where("g1 <> g2").withColumn("_r", F.row_number().over(Window.partitionBy("g1").orderBy(F.col("cos").desc(), "g2"))).where("_r = 1")
    n = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(intra, "label", "left").join(purity.groupBy("label").agg(F.avg("purity").alias("purity")), "label", "left").join(other.select(F.col("g1").alias("label"), F.col("g2").alias("nearest"), F.col("cos").alias("nearest_cos")), "label", "left")


def kmeans(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, cluster) of unit rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def unsupervised(rows: DataFrame, ks: range = range(3, 13), seed: int = 0) -> DataFrame:
    """(id, label): k-means with the k of the best cosine silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = rows.select("id", array_to_vector("vec").alias("features"))
    judge = ClusteringEvaluator(distanceMeasure="cosine")
    n = data.count()
    tried = [(judge.evaluate(p), -k, p) for k in ks if k < n and (p := KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data)) is not None]
    return max(tried, key=lambda x: x[:2])[2].select("id", F.col("prediction").alias("label"))


def stability(rows: DataFrame, k: int, draws: int = 8, share: float = 0.8) -> DataFrame:
    """(draw, ari): agreement of a clustering of a part with that of all rows."""
    spark = rows.sparkSession
    whole = kmeans(rows, k).withColumnRenamed("cluster", "c0")
    out = []
    for s in range(draws):
        part = rows.where(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) < int(1000 * share))
        table = kmeans(part, k, s).join(whole, "id").groupBy("cluster", "c0").count().toPandas()
        grid = table.pivot(index="cluster", columns="c0", values="count").fillna(0).to_numpy()
        out.append((s, numeric.adjusted_rand(grid)))
    return spark.createDataFrame(out, "draw int, ari double")


#: Nodes up to which all eigenvalues are computed; vectors that are iterated beyond, and the degree of their filter.
DENSE, WIDTH, DEGREE = 1200, 32, 10


def eigengap(edges: DataFrame, first: int = 13) -> DataFrame:
    """One row (n_modes): the number of groups by the largest gap of the normalized Laplacian's first 13 eigenvalues.

    All nodes of the undirected graph count. One task holds the edges as numbers and WIDTH vectors over the nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
        if got:
            ends = np.concatenate([np.concatenate([g[k] for g in got]) for k in (0, 1)])
            ids, at = np.unique(ends, return_inverse=True)
            a, b = at[: len(at) // 2], at[len(at) // 2 :]
            values = laplacian_values(a, b, len(ids), first)
            yield pa.RecordBatch.from_pydict({"n_modes": pa.array([int(np.diff(values).argmax()) + 1 if len(values) > 1 else 1], pa.int32())})

    return edges.select("src", "dst").repartition(1).mapInArrow(run, "n_modes int")


def laplacian_values(a: np.ndarray, b: np.ndarray, n: int, first: int, dense: int = DENSE, seed: int = 0) -> np.ndarray:
    """The least `first` eigenvalues of the normalized Laplacian of the undirected graph with edges (a, b) of nodes 0 to n - 1.

    Of many nodes by subspace iteration under Chebyshev filters, until the vectors' residuals are small beside what sets
    the largest gap off from the next (or below 1e-8).
    """
    if n <= dense:
        w = np.zeros((n, n))
        w[a, b] = w[b, a] = 1
        d = np.maximum(w.sum(axis=1), 1e-12)
        return np.sort(np.linalg.eigvalsh(np.eye(n) - w / np.sqrt(d[:, None] * d[None, :])))[:first]
    keys = np.unique(np.concatenate([a * np.int64(n) + b, b * np.int64(n) + a]))
    row, column = np.divmod(keys, n)
    degree = np.bincount(row, minlength=n)
    starts = np.concatenate([[0], np.cumsum(degree)])
    scale = 1 / np.sqrt(np.maximum(degree, 1e-12))[:, None]
    step = 1 << 14

    def times(x: np.ndarray) -> np.ndarray:
        x = x * scale
        out = np.zeros_like(x)
        for at in range(0, n, step):
            own = np.flatnonzero(degree[at : at + step]) + at
            if len(own):
                out[own] = np.add.reduceat(x[column[starts[at] : starts[min(n, at + step)]]], starts[own] - starts[at], axis=0)
        out *= scale
        return out

    x = np.random.default_rng(seed).standard_normal((n, WIDTH))
    x[:, 0] = np.sqrt(degree)
    for turn in range(1000):
        x = np.linalg.qr(x)[0]
        ax = times(x)
        values, turned = np.linalg.eigh(x.T @ ax)
        x, ax, values = x @ turned[:, ::-1], ax @ turned[:, ::-1], values[::-1]
        far = float(np.linalg.norm(ax[:, :first] - x[:, :first] * values[:first], axis=0).max())
        gaps = np.sort(-np.diff(values[:first]))
        if turn and far < max(1e-8, min(1e-3, (gaps[-1] - gaps[-2]) / 8)):
            return 1 - values[:first]
        # what lies between -1 and the least value stays small, what lies above grows
        half, middle = (values[-1] + 1) / 2, (values[-1] - 1) / 2
        if half < 1e-9:
            continue
        before, x = x, (ax - middle * x) / half
        for _ in range(DEGREE - 1):
            before, x = x, 2 * (times(x) - middle * x) / half - before
    raise ValueError(f"the eigenvalues don't settle: residual {far:.1e} after 1000 turns")

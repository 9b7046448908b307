"""Crowding of single items, and tight pockets: trees over bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..sources.scratch import kept
from .order import quantiles
from .pairs import sums

#: Rows at most for the trees, which are built on the driver.
TREE = 4096


def item_collisions(rows: DataFrame, sigma: float) -> DataFrame:
    """(id, collisions): what each unit row expects under noise of width sigma."""
    return sums(rows, rows, lambda c: numeric.confusion(c, sigma)).select("id", F.col("total").alias("collisions"))


def bounded(rows: DataFrame, most: int = TREE) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of at most `most` rows by order of id, on the driver; more is an error."""
    got = rows.select("id", "vec").orderBy("id").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: sample them first")
    return np.array([r["id"] for r in got]), np.array([r["vec"] for r in got])


def spanning_tree(dist: np.ndarray) -> np.ndarray:
    """Prim's tree over a distance matrix: rows (a, b, distance) in the order they join."""
    n = len(dist)
    inside = np.zeros(n, bool)
    best, near = np.full(n, np.inf), np.zeros(n, int)
    out, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (dist[at] < best) & ~inside
        best[closer], near[closer] = dist[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        out.append((near[at], at, best[at]))
    return np.array(out).reshape(-1, 3)


def mutual_reachability(x: np.ndarray, core: int) -> np.ndarray:
    """Chord distances, none below either end's distance to its core-th neighbour."""
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    k = min(core, len(x) - 1)
    near = np.partition(d, k, axis=1)[:, k]
    d = np.maximum(d, np.maximum(near[:, None], near[None, :]))
    np.fill_diagonal(d, 0)
    return d


def pockets(x: np.ndarray, least: int = 20, core: int | None = None, most: int = 12) -> list[dict]:
    """Tight groups of unit vectors: size, birth, death, prominence, members (row numbers).

    Single linkage over mutual reachability, condensed: a split counts where both sides have
    `least` rows. Groups of the greatest excess of mass (in 1 / distance) are taken, of each the
    part that stays together longest. Death is the distance at which it is joined to anything
    else, birth the median reach of its members; members lie within their geometric mean.
    """
    n = len(x)
    if n < 2 * least:
        return []
    tree = spanning_tree(mutual_reachability(x, core or max(5, n // 256)))
    tree = tree[np.argsort(tree[:, 2], kind="stable")]
    parent = list(range(2 * n - 1))
    size, height, kids = [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1), {}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, d) in enumerate(tree):
        p, q = top(int(a)), top(int(b))
        new = n + k
        parent[p] = parent[q] = new
        size[new], height[new], kids[new] = size[p] + size[q], max(float(d), 1e-9), (p, q)

    def leaves(node: int) -> list[int]:
        todo, got = [node], []
        while todo:
            i = todo.pop()
            if i < n:
                got.append(i)
            else:
                todo += kids[i]
        return got

    groups: list[dict] = []

    def walk(node: int, death: float) -> int:
        """Follow a group down to its split; returns its number in groups."""
        me = {"node": node, "death": death, "mass": 0.0, "children": [], "leave": []}
        groups.append(me)
        number, at = len(groups) - 1, node
        while at >= n:
            p, q = kids[at]
            lam = 1 / height[at]
            if size[p] >= least and size[q] >= least:
                me["mass"] += (size[p] + size[q]) * (lam - (1 / death if np.isfinite(death) else 0.0))
                me["children"] = [walk(p, height[at]), walk(q, height[at])]
                return number
            small, big = (p, q) if size[p] < size[q] else (q, p)
            gone = small if size[small] < least else None
            if gone is not None:
                me["mass"] += size[gone] * (lam - (1 / death if np.isfinite(death) else 0.0))
                me["leave"].append((height[at], size[gone]))
            if size[big] < least:
                me["mass"] += size[big] * (lam - (1 / death if np.isfinite(death) else 0.0))
                me["leave"].append((height[at], size[big]))
                return number
            at = big
        return number

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * n))
    walk(2 * n - 2, np.inf)

    def choose(g: int) -> tuple[float, list[int]]:
        own, kept = groups[g]["mass"], [g]
        if groups[g]["children"]:
            below = [choose(c) for c in groups[g]["children"]]
            total = sum(m for m, _ in below)
            if g == 0 or total >= own:
                return total, [x for _, y in below for x in y]
        return own, kept

    _, chosen = choose(0)
    out = []
    for g in chosen:
        # the part of the group that stays together over the widest range of heights: rows that
        # chain themselves to it one by one are no members
        at, above = groups[g]["node"], groups[g]["death"]
        best, node, death = 1.0, None, 0.0
        while at >= n and size[at] >= least:
            if np.isfinite(above) and above / height[at] > best:
                best, node, death = above / height[at], at, above
            above, at = height[at], max(kids[at], key=lambda i: size[i])
        if node is None:
            continue
        members = leaves(node)
        reach = _reach(node, members, kids, height, n)
        birth = float(np.median(reach))
        kept = [m for m, r in zip(members, reach, strict=True) if r <= np.sqrt(birth * death)]
        if len(kept) >= max(2, least // 2) and death > birth:
            out.append({"size": len(kept), "birth": birth, "death": float(death), "prominence": float(death - birth), "members": sorted(kept)})
    return sorted(out, key=lambda p: -p["prominence"])[:most]


def _reach(node: int, members: list[int], kids: dict, height: list[float], n: int) -> np.ndarray:
    """For each member, in order, the height at which it first joins another member."""
    first: dict[int, float] = {}
    todo = [node]
    while todo:
        i = todo.pop()
        if i < n:
            continue
        for k in kids[i]:
            if k < n:
                first[k] = height[i]
            else:
                todo.append(k)
    return np.array([first.get(m, 0.0) for m in members])


def uniform(n: int, d: int, seed: int) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def null_prominence(n: int, d: int, least: int, draws: int = 3) -> float:
    """The greatest prominence in uniform draws of the same shape."""
    return max((p["prominence"] for s in range(draws) for p in pockets(uniform(n, d, s), least)[:1]), default=0.0)


def pocket_table(spark: SparkSession, rows: DataFrame, least: int = 20, floor: float = 0.0) -> DataFrame:
    """(pocket, size, birth, death, prominence, members): prominence above twice the floor."""
    ids, x = bounded(rows)
    found = [p for p in pockets(x, least) if p["prominence"] > 2 * floor]
    kind = rows.schema["id"].dataType.simpleString()
    data = [(i, p["size"], p["birth"], p["death"], p["prominence"], [ids[m].item() for m in p["members"]]) for i, p in enumerate(found)]
    return spark.createDataFrame(data, f"pocket int, size int, birth double, death double, prominence double, members array<{kind}>")


def tree_table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(a, b, dist): the minimum spanning tree of cosine distance over a bounded sample."""
    ids, x = bounded(rows)
    edges = spanning_tree(1 - x @ x.T)
    kind = rows.schema["id"].dataType.simpleString()
    data = [(*sorted((ids[int(a)].item(), ids[int(b)].item())), float(d)) for a, b, d in edges]
    return spark.createDataFrame(data, f"a {kind}, b {kind}, dist double")


def hot_edges(edges: DataFrame, most: int = 600) -> DataFrame:
    """Tree edges at least three robust deviations shorter than the median."""
    med = edges.agg(F.percentile("dist", 0.5).alias("m"))
    mad = edges.join(F.broadcast(med)).agg(F.max("m").alias("m"), (1.4826 * F.percentile(F.abs(F.col("dist") - F.col("m")), 0.5)).alias("s"))
    return edges.join(F.broadcast(mad)).where("dist <= m - 3 * s").drop("m", "s").orderBy("dist").limit(most)


def field(rows: DataFrame, edges: DataFrame, dim: int, scales: tuple[int, ...] = (10, 50, 200), reference: int = 2000, alpha: float = 0.01, mutual: bool = False) -> DataFrame:
    """(id, k, density, z, crowded): local density at several scales, its robust z, and whether that is beyond what uniform rows of matched density have.

    edges: the neighbour graph up to the largest scale; scales beyond the rows are left out. mutual:
    density over reciprocal neighbours only.
    """
    from .neighbours import densities

    spark = rows.sparkSession
    n = rows.count()
    scales = tuple(k for k in scales if k < n) or (max(1, n - 1),)
    x = uniform(min(reference, n), dim, 5)
    g = np.sort(x @ x.T - 2 * np.eye(len(x)), axis=1)[:, ::-1]
    cut = {}
    for k in scales:
        at = max(1, min(len(x) - 1, round(k * len(x) / n)))
        d = g[:, :at].mean(axis=1)
        mad = max(1e-9, 1.4826 * float(np.median(np.abs(d - np.median(d)))))
        cut[k] = (float(np.median(d)), mad, float(np.quantile((d - np.median(d)) / mad, 1 - alpha / len(scales))))
    table = F.broadcast(spark.createDataFrame([(k, *v) for k, v in cut.items()], "k int, null_median double, null_mad double, cut double"))
    wide = kept(densities(edges, list(scales), mutual))
    # rows without a reciprocal neighbour have the least density of all
    least = wide.agg(*(F.coalesce(F.min(f"k{k}"), F.lit(0.0)).alias(f"k{k}") for k in scales)).first()
    wide = wide.select("id", *(F.coalesce(f"k{k}", F.lit(least[f"k{k}"])).alias(f"k{k}") for k in scales))
    long = wide.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("density")) for k in scales))))
    middle = {}
    for k in scales:
        d = wide.select(F.col(f"k{k}").alias("density"))
        med = quantiles(d, "density", [0.5])[0] or 0.0
        spread = quantiles(d.select(F.abs(F.col("density") - med).alias("a")), "a", [0.5])[0] or 0.0
        middle[k] = (med, max(1.4826 * spread, 1e-9))
    mad = spark.createDataFrame([(k, *v) for k, v in middle.items()], "k int, median double, mad double")
    told = long.join(F.broadcast(mad), "k").join(table, "k").withColumn("z", (F.col("density") - F.col("median")) / F.col("mad"))
    return told.select("id", "k", "density", "z", (F.col("z") > F.col("cut")).alias("crowded"), "median", "mad", "null_median", "null_mad", "cut")


def scales_of(long: DataFrame) -> DataFrame:
    """(k, median, mad, cut, spread, global_crowding, scale_star) of field(): the scale of the longest upper tail is scale_star."""
    keys = ["k", "median", "mad", "cut"]
    by = long.groupBy(*keys, "null_median", "null_mad").agg(((F.percentile("density", 0.99) - F.col("median")) / F.col("mad")).alias("spread"))
    by = by.withColumn("global_crowding", (F.col("median") - F.col("null_median")) / F.col("null_mad"))
    top = by.agg(F.max_by("k", F.struct("spread", -F.col("k"))).alias("_k"))
    return by.join(F.broadcast(top)).select(*keys, "spread", "global_crowding", (F.col("k") == F.col("_k")).alias("scale_star"))


def crowded_rows(long: DataFrame) -> DataFrame:
    """(id, crowded): crowded at any scale."""
    return long.groupBy("id").agg(F.max("crowded").alias("crowded"))


def angular_pockets(rows: DataFrame, long: DataFrame) -> DataFrame:
    """(pocket, size, concentration, isoscore_shrunk, z, members): groups of crowded rows by angle.

    Few crowded rows (under 8 and 0.2 %) or small groups (under 5 and 0.1 %) make none. One task holds the vectors of the
    crowded rows and links them; the time grows as their number's square, the memory as their number.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    names = f"pocket int, size int, concentration double, isoscore_shrunk double, z double, members array<{kind}>"
    n = rows.count()
    star = scales_of(long).where("scale_star").first()
    crowded = crowded_rows(long).where("crowded").select("id")
    if star is None or crowded.count() < max(8, int(n * 0.002)):
        return spark.createDataFrame([], names)
    own = rows.select("id", "vec").join(long.where(F.col("k") == star["k"]).join(crowded, "id", "left_semi").select("id", "density", "z"), "id")
    least = max(5, int(n * 0.001))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        all_ = pd.concat(got).sort_values("id", ignore_index=True)
        x, density, z = np.stack(all_["vec"].to_list()), all_["density"].to_numpy(), all_["z"].to_numpy()
        far = float(np.clip(1 - 0.5 * density.mean(), 0.35, 0.95))
        found = []
        for g in angular_groups(x, 1 - far):
            if len(g) >= least:
                e = numeric.eigenvalues(np.cov(x[g].T))
                found.append((len(g), float(density[g].mean()), numeric.shrunk_isoscore(e, len(g)), float(z[g].max()), all_["id"].iloc[g].tolist()))
        found.sort(key=lambda p: (-p[3], p[4]))
        if found:
            yield pd.DataFrame([(i, *p) for i, p in enumerate(found)], columns=["pocket", "size", "concentration", "isoscore_shrunk", "z", "members"])

    return own.repartition(1).mapInPandas(run, names)


def angular_groups(x: np.ndarray, cosine: float) -> list[list[int]]:
    """Average linkage of unit rows, cut at a mean cosine: the groups' row numbers, in order.

    The mean cosine of two groups is the product of their mean vectors, so no matrix of pairs is held. Chains of nearest
    groups find the same merges as taking the closest two of all does; a group with nothing at `cosine` or above never
    gets anything, since a merge brings no group nearer to others than its nearer part was.
    """
    groups = [[i] for i in range(len(x))]
    mean, size = x.copy(), np.ones(len(x))
    alive = np.ones(len(x), bool)
    done: list[list[int]] = []
    chain: list[int] = []
    while alive.any():
        if 2 * alive.sum() < len(alive) and not chain:  # drop what is done with
            mean, size, groups = mean[alive], size[alive], [g for g, a in zip(groups, alive, strict=True) if a]
            alive = np.ones(len(mean), bool)
        if not chain:
            chain.append(int(alive.argmax()))
        at = chain[-1]
        near = mean @ mean[at]
        near[~alive] = -np.inf
        near[at] = -np.inf
        to = int(near.argmax())
        if near[to] < cosine:
            alive[at] = False
            done.append(groups[at])
            chain.pop()
        elif len(chain) > 1 and near[chain[-2]] >= near[to] - 1e-15:
            to = chain[-2]
            del chain[-2:]
            both = size[at] + size[to]
            mean[to] = (size[at] * mean[at] + size[to] * mean[to]) / both
            size[to] = both
            groups[to] = groups[to] + groups[at]
            alive[at] = False
        else:
            chain.append(to)
    return sorted(sorted(g) for g in done)

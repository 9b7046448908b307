"""Projection to principal axes, and statistics of points in a plane or space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from .moments import Moments
from .order import quantiles


def axes(m: Moments, k: int) -> np.ndarray:
    """The k leading eigenvectors, each with its largest component positive."""
    values, vectors = np.linalg.eigh(m.cov)
    top = vectors[:, ::-1][:, :k].T
    sign = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
    return top * sign[:, None]


def pca(rows: DataFrame, m: Moments, k: int = 3) -> DataFrame:
    """(id, x, y, z ...) of centred rows on the leading axes."""
    w, mean = axes(m, k), m.mean
    centred = F.zip_with("vec", F.array(*(F.lit(float(v)) for v in mean)), lambda a, b: a - b)
    names = ["x", "y", "z"][:k] if k <= 3 else [f"c{i + 1}" for i in range(k)]
    return rows.select("id", centred.alias("_c")).select("id", *(vec.dot(F.col("_c"), F.array(*(F.lit(float(v)) for v in a))).alias(n) for a, n in zip(w, names, strict=True)))


def boxed(points: DataFrame, names: list[str]) -> DataFrame:
    """Every axis from 0 to 1 between its ends; an axis without extent is 0."""
    ends = points.agg(*(f(c).alias(f"_{n}{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))))
    out = points.join(F.broadcast(ends))
    for c in names:
        lo, hi = F.col(f"_lo{c}"), F.col(f"_hi{c}")
        out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
    return out.select(*points.columns)


def cells(points: DataFrame, names: list[str], sizes: list[int]) -> DataFrame:
    """(cell of every axis, n): counts on a grid over the box of the points."""
    at = [F.least(F.floor(F.col(c) * s), F.lit(s - 1)).cast("bigint").alias(f"c{c}") for c, s in zip(names, sizes, strict=True)]
    return boxed(points, names).groupBy(*at).agg(F.count(F.lit(1)).alias("n"))


def hot(counts: DataFrame, share: float) -> DataFrame:
    """counts with hot: at or above that quantile of the occupied cells."""
    cut = counts.agg(F.percentile("n", share).alias("_q"))
    return counts.join(F.broadcast(cut)).withColumn("hot", F.col("n") >= F.col("_q")).drop("_q")


def _hexagon(width: float) -> tuple:
    """The centre (q, r) that is nearest to (x, y): of the two candidate rows of centres the nearer one has it."""
    h = width * math.sqrt(3) / 2
    a_r, a_q = F.rint(F.col("y") / (2 * h)), F.rint(F.col("x") / width)
    b_r, b_q = F.floor(F.col("y") / (2 * h)) + 0.5, F.floor(F.col("x") / width) + 0.5
    d = lambda q, r: (F.col("x") - q * width) ** 2 + (F.col("y") - r * 2 * h) ** 2
    first = d(a_q, a_r) <= d(b_q, b_r)
    return F.when(first, a_q).otherwise(b_q), F.when(first, a_r).otherwise(b_r)


def hexagons(points: DataFrame, width: float) -> DataFrame:
    """(q, r, n): counts by the nearest centre of a hexagonal lattice with that spacing, of points in the unit box."""
    q, r = _hexagon(width)
    return boxed(points, ["x", "y"]).groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("n"))


def shifted_hexagons(points: DataFrame, width: float) -> DataFrame:
    """(q, r, mean, own): hexagons() averaged over nine lattices shifted by thirds of its periods."""
    b = boxed(points, ["x", "y"])
    thirds = F.explode(F.array(*map(F.lit, range(3))))
    moved = b.select("x", "y", thirds.alias("a")).select("*", thirds.alias("b"))
    at = moved.select((F.col("x") + F.col("a") * width / 3).alias("x"), (F.col("y") + F.col("b") * width * math.sqrt(3) / 3).alias("y"), ((F.col("a") == 0) & (F.col("b") == 0)).alias("own"))
    q, r = _hexagon(width)
    return at.groupBy(q.alias("q"), r.alias("r")).agg((F.count(F.lit(1)) / 9.0).alias("mean"), F.max("own").alias("own"))


def blurred(counts: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(cx, cy, v): the mean over each cell and its neighbours in the grid, edges clamped; empty cells count as 0."""
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    spread = counts.select("cx", "cy", "n", step.alias("dx")).select("*", step.alias("dy"))
    at = spread.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "n")
    inside = at.where((F.col("cx") >= 0) & (F.col("cx") < sizes[0]) & (F.col("cy") >= 0) & (F.col("cy") < sizes[1]))
    wide = lambda c, s: F.when((F.col(c) == 0) | (F.col(c) == s - 1), 2).otherwise(3)
    return inside.groupBy("cx", "cy").agg(F.sum("n").alias("s")).select("cx", "cy", (F.col("s") / (wide("cx", sizes[0]) * wide("cy", sizes[1]))).alias("v"))


def log_ratio(counts: DataFrame, size: int, spread: float = 3.0) -> DataFrame:
    """counts (cx, cy, n) with the log2 ratio to a standard Gaussian on a square of +- spread, within +- 3."""
    total = counts.agg(F.sum("n").alias("_t"))
    at = lambda c: (F.col(c) + 0.5) / size * 2 * spread - spread
    area = (2 * spread / size) ** 2
    ref = F.exp(-(at("cx") ** 2 + at("cy") ** 2) / 2) / (2 * math.pi) * area
    ratio = F.log2((F.col("n") / F.col("_t") + 1e-6) / (ref + 1e-6))
    return counts.join(F.broadcast(total)).select("cx", "cy", "n", F.greatest(F.least(ratio, F.lit(3.0)), F.lit(-3.0)).alias("log_ratio"))


def shells(points: DataFrame, names: list[str], n: int = 6) -> DataFrame:
    """(id, radius, shell): distance from the centroid, and its quantile shell from 0."""
    mean = points.agg(*(F.avg(c).alias(f"_m{c}") for c in names))
    r = F.sqrt(sum((F.col(c) - F.col(f"_m{c}")) ** 2 for c in names))
    far = points.join(F.broadcast(mean)).select("id", r.alias("radius"))
    cut = F.array(*(F.lit(q).cast("double") for q in quantiles(far, "radius", [i / n for i in range(1, n)])))
    return far.select("id", "radius", F.size(F.filter(cut, lambda q: q < F.col("radius"))).alias("shell"))


def radial(shell: DataFrame, bins: int = 22, power: int = 3) -> DataFrame:
    """(bin, n, density): counts by radius over each bin's share of the volume."""
    far = shell.agg(F.max("radius").alias("_r"), F.count(F.lit(1)).alias("_n"))
    b = F.least(F.floor(F.col("radius") / F.col("_r") * bins), F.lit(bins - 1)).cast("bigint")
    out = shell.join(F.broadcast(far)).groupBy(b.alias("bin"), "_n").agg(F.count(F.lit(1)).alias("n"))
    volume = ((F.col("bin") + 1.0) / bins) ** power - (F.col("bin") / float(bins)) ** power
    return out.select("bin", "n", (F.col("n") / F.col("_n") / volume).alias("density"))


def camera(points: DataFrame, azimuth: float = 35.0, elevation: float = 22.0) -> DataFrame:
    """(id, u, v, depth) as seen from that direction."""
    a, e = math.radians(azimuth), math.radians(elevation)
    right = (-math.sin(a), math.cos(a), 0.0)
    toward = (math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e))
    up = (toward[1] * right[2] - toward[2] * right[1], toward[2] * right[0] - toward[0] * right[2], toward[0] * right[1] - toward[1] * right[0])
    at = lambda w: F.col("x") * w[0] + F.col("y") * w[1] + F.col("z") * w[2]
    return points.select("id", at(right).alias("u"), at(up).alias("v"), at(toward).alias("depth"))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points in a plane, counter-clockwise."""
    p = sorted(map(tuple, points.tolist()))
    if len(p) < 3:
        return np.array(p)

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def hull_candidates(points: DataFrame) -> DataFrame:
    """(x, y): the corners of the hulls of parts of the points; the hull of all is theirs."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((0, 2))
        for b in batches:
            own = hull(np.vstack([own, b[["x", "y"]].to_numpy()]))
        if len(own):
            yield pd.DataFrame(own, columns=["x", "y"])

    # twice: of every task's points, and of at most 64 groups of tasks' corners
    first = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").mapInPandas(corners, "x double, y double")
    return first.repartition(64).mapInPandas(corners, "x double, y double")


def voids(points: DataFrame, nx: int = 120, ny: int = 90, most: int = 8, least: float = 0.18) -> list[tuple[float, float, float]]:
    """Greedy empty discs (x, y, radius) in the unit box: grid points far from every point. Each task keeps the grid's least distances."""
    gx, gy = np.meshgrid((np.arange(nx) + 0.5) / nx, (np.arange(ny) + 0.5) / ny)
    at = np.column_stack([gx.ravel(), gy.ravel()])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(len(at), np.inf)
        for b in batches:
            p = b[["x", "y"]].drop_duplicates().to_numpy()
            for i in range(0, len(p), 256):
                best = np.minimum(best, ((at[:, None, :] - p[None, i : i + 256]) ** 2).sum(axis=2).min(axis=1))
        if np.isfinite(best).any():
            yield pd.DataFrame({"k": np.arange(len(at)), "d": best})

    rows = boxed(points, ["x", "y"]).select("x", "y").mapInPandas(near, "k int, d double").groupBy("k").agg(F.min("d").alias("d")).collect()  # a row for each grid point
    dist = np.zeros(len(at))
    for r in rows:
        dist[r["k"]] = math.sqrt(r["d"])
    out: list[tuple[float, float, float]] = []
    for i in np.argsort(-dist, kind="stable"):
        r = float(dist[i])
        if len(out) == most or not r or (out and r < least * out[0][2]):
            break
        if all((at[i][0] - x) ** 2 + (at[i][1] - y) ** 2 > (r + s) ** 2 for x, y, s in out):
            out.append((float(at[i][0]), float(at[i][1]), r))
    return out


def peaks(grid: np.ndarray, least: float = 0.0) -> list[tuple[int, int, float, float]]:
    """(row, column, height, prominence) of local maxima over eight neighbours, by flooding from the top."""
    rows, columns = grid.shape
    owner = -np.ones(grid.shape, int)
    top: list[tuple[int, int]] = []
    merged: dict[int, float] = {}
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for flat in np.argsort(-grid, axis=None, kind="stable"):
        r, c = divmod(int(flat), columns)
        around = {find(owner[a, b]) for a in range(max(0, r - 1), min(rows, r + 2)) for b in range(max(0, c - 1), min(columns, c + 2)) if owner[a, b] >= 0}
        if not around:
            parent.append(len(top))
            top.append((r, c))
            owner[r, c] = len(top) - 1
            continue
        best = max(around, key=lambda i: (grid[top[i]], -i))
        owner[r, c] = best
        for other in around - {best}:
            merged[other] = float(grid[r, c])
            parent[other] = best
    out = [(r, c, float(grid[r, c]), float(grid[r, c] - merged.get(i, grid.min()))) for i, (r, c) in enumerate(top)]
    return sorted((p for p in out if p[3] > least), key=lambda p: -p[3])


def contours(grid: np.ndarray, level: float) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """Segments of the level line, by linear interpolation on the sides of every cell."""
    out = []
    for i in range(grid.shape[0] - 1):
        for j in range(grid.shape[1] - 1):
            corner = [((i, j), grid[i, j]), ((i, j + 1), grid[i, j + 1]), ((i + 1, j + 1), grid[i + 1, j + 1]), ((i + 1, j), grid[i + 1, j])]
            hits = []
            for (p, a), (q, b) in zip(corner, corner[1:] + corner[:1], strict=True):
                if (a >= level) != (b >= level):
                    t = (level - a) / (b - a)
                    hits.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            out += [(hits[k], hits[k + 1]) for k in range(0, len(hits) - 1, 2)]
    return out


def polylines(segments: list[tuple[tuple[float, float], tuple[float, float]]], digits: int = 9) -> list[list[tuple[float, float]]]:
    """Segments joined at equal ends; a closed line ends where it begins."""
    key = lambda p: (round(p[0], digits), round(p[1], digits))
    ends: dict = {}
    for k, (p, q) in enumerate(segments):
        ends.setdefault(key(p), []).append(k)
        ends.setdefault(key(q), []).append(k)
    left, out = set(range(len(segments))), []

    def follow(line: list) -> list:
        while k := next((i for i in ends.get(key(line[-1]), ()) if i in left), None) if left else None:
            left.discard(k)
            p, q = segments[k]
            line.append(q if key(p) == key(line[-1]) else p)
        return line

    for k in range(len(segments)):
        if k in left:
            left.discard(k)
            line = follow(list(segments[k]))
            out.append(follow(line[::-1])[::-1])
    return out


def smoothed(grid: np.ndarray, sigma: float = 1.2) -> np.ndarray:
    """Gaussian smoothing, edges clamped."""
    r = math.ceil(3 * sigma)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in (0, 1):
        wide = np.pad(grid, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        grid = sum(t * np.take(wide, range(i, i + grid.shape[axis]), axis=axis) for i, t in enumerate(taps / taps.sum()))
    return grid


def dense(counts: DataFrame, sizes: tuple[int, int], value: str = "n") -> np.ndarray:
    """The grid as an array on the driver: as large as the grid."""
    out = np.zeros(sizes)
    for r in counts.select("cx", "cy", value).collect():
        out[r["cx"], r["cy"]] = r[value]
    return out


def betweenness(edges, nodes: list, sources: int = 220, seed: int = 0) -> tuple[dict, dict]:
    """Sampled shortest-path betweenness (Brandes) of the nodes and of the edges (a, b) of a bounded undirected graph of (a, b, dist) rows."""
    import heapq

    near: dict = {v: [] for v in nodes}
    lines = {}
    for a, b, d in edges:
        near[a].append((b, d))
        near[b].append((a, d))
        lines[a, b] = lines[b, a] = (a, b)
    random = np.random.default_rng(seed)
    start = [nodes[i] for i in random.permutation(len(nodes))[:sources]]
    score, over = dict.fromkeys(nodes, 0.0), dict.fromkeys(lines.values(), 0.0)
    for s in start:
        dist, paths, before, order, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, str(s), s)]
        done = set()
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, x in near[v]:
                if w in done:
                    continue
                new = d + x
                if w not in dist or new < dist[w] - 1e-12:
                    dist[w], paths[w], before[w] = new, paths[v], [v]
                    heapq.heappush(heap, (new, str(w), w))
                elif abs(new - dist[w]) <= 1e-12:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for p in before[v]:
                part = paths[p] / paths[v] * (1 + share[v])
                share[p] += part
                over[lines[p, v]] += part
            if v != s:
                score[v] += share[v]
    scale = len(nodes) / max(1, len(start))
    return {v: x * scale for v, x in score.items()}, {e: x * scale for e, x in over.items()}


def bridges(edges, at: dict, roots: dict, least: int = 6, sources: int = 60) -> list[tuple]:
    """(a, b, gap, score) on a bounded graph of (a, b, dist) rows: of one component the edges of most betweenness and
    span, of several the nearest nodes of every two in the plane. at: node -> (x, y); roots: node -> component."""
    span = lambda a, b: math.dist(at[a], at[b])
    groups: dict = {}
    for v, r in roots.items():
        groups.setdefault(r, []).append(v)
    if len(groups) > 1:
        out = []
        names = sorted(groups)
        for i, g in enumerate(names):
            p = np.array([at[v] for v in groups[g]])
            for h in names[i + 1 :]:
                q = np.array([at[v] for v in groups[h]])
                best = min(((float(d.min()), k + divmod(int(d.argmin()), len(q))[0], int(d.argmin()) % len(q)) for k in range(0, len(p), 512) for d in [((p[k : k + 512, None] - q[None]) ** 2).sum(axis=2)]), key=lambda x: x[0])
                out.append((groups[g][best[1]], groups[h][best[2]], math.sqrt(best[0]), 0.0))
        return sorted(out, key=lambda x: x[2])
    _, over = betweenness(edges, list(at), sources)
    most, widest = max(over.values(), default=1.0) or 1.0, max((span(a, b) for a, b in over), default=1.0) or 1.0
    told = [(a, b, span(a, b), x / most * (0.4 + 0.6 * span(a, b) / widest)) for (a, b), x in over.items()]
    return sorted(told, key=lambda x: (-x[3], x[0], x[1]))[: max(least, len(groups))]


def graph_components(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the least id that every node reaches over the edges, by minimum labels that double their reach."""
    from ..sources.scratch import kept

    both = kept(edges.select(F.col(a).alias("s"), F.col(b).alias("d")).union(edges.select(F.col(b), F.col(a))).distinct())
    label = kept(nodes.select("id", F.col("id").alias("root")))
    while True:
        seen = both.join(label.withColumnRenamed("id", "s"), "s").groupBy(F.col("d").alias("id")).agg(F.min("root").alias("m"))
        near = label.join(seen, "id", "left").select("id", "root", F.least("root", "m").alias("new"))
        hop = near.select(F.col("id").alias("new"), F.col("new").alias("far"))
        after = kept(near.join(hop, "new", "left").select("id", "root", F.least("new", "far").alias("next")))
        if after.where("next <> root").isEmpty():
            return after.select("id", F.col("next").alias("root"))
        label = after.select("id", F.col("next").alias("root"))

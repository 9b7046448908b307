"""Two embeddings of the same items, matched by id as text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from ..sources.scratch import kept
from . import pairs
from .pairs import sums


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, va, vb) for ids that both have; of ids that repeat the row with the least vector hash."""

    def once(x: DataFrame, name: str) -> DataFrame:
        keyed = x.select(F.col("id").cast("string").alias("id"), F.col("vec").alias(name))
        r = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(name)))
        return keyed.withColumn("_r", r).where("_r = 1").drop("_r")

    return once(a, "va").join(once(b, "vb"), "id")


def checked_align(a: DataFrame, b: DataFrame) -> DataFrame:
    both = align(a, b)
    if both.isEmpty():
        raise ValueError("the two sets have no id in common")
    return both


def rows_of(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, row, found): the row number that ids (id, row) has for each wanted id, else -1."""
    known = ids.select(F.col("id").cast("string").alias("id"), "row").groupBy("id").agg(F.min("row").alias("row"))
    out = wanted.select(F.col("id").cast("string").alias("id")).join(known, "id", "left")
    return out.select("id", F.coalesce("row", F.lit(-1).cast("bigint")).alias("row"), F.col("row").isNotNull().alias("found"))


def drift(both: DataFrame) -> DataFrame:
    """(id, drift, cos): length of the step and cosine of the two unit vectors; null where lengths differ."""
    same = F.size("va") == F.size("vb")
    d = F.when(same, F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, x: s + x)))
    return both.select("id", d.alias("drift"), F.when(same, vec.dot(F.col("va"), F.col("vb"))).alias("cos"))


def drift_cells(points: DataFrame, size: int) -> DataFrame:
    """(cx, cy, n, drift, dx, dy, over60, over95) of points (x, y in the unit box, d, dx, dy): means by cell."""
    at = [F.least(F.floor(F.col(c) * size), F.lit(size - 1)).cast("bigint").alias(f"c{c}") for c in "xy"]
    g = points.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("drift"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    q = g.agg(F.percentile("drift", F.array(F.lit(0.6), F.lit(0.95))).alias("_q"))
    return g.join(F.broadcast(q)).withColumns({"over60": F.col("drift") >= F.col("_q")[0], "over95": F.col("drift") >= F.col("_q")[1]}).drop("_q")


def cross_grams(both: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centred X'Y, X'X and Y'Y, from the moments of the two vectors side by side."""
    from .moments import moments

    m = moments(both.select(F.concat("va", "vb").alias("vec")))
    d = both.select(F.size("va")).first()[0]
    c = m.cov * max(1, m.n - 1)
    return c[:d, d:], c[:d, :d], c[d:, d:]


def block_cka(both: DataFrame) -> float:
    xy, xx, yy = cross_grams(both)
    return float((xy**2).sum() / np.sqrt((xx**2).sum() * (yy**2).sum()))


def procrustes(both: DataFrame) -> float:
    """What the best rotation leaves of the centred second set, relative to it; one dimension count."""
    xy, xx, yy = cross_grams(both)
    if xy.shape[0] != xy.shape[1]:
        raise ValueError("the vectors' lengths differ")
    return float(max(0.0, 1 - 2 * np.linalg.svd(xy, compute_uv=False).sum() / np.trace(yy) + np.trace(xx) / np.trace(yy)))


def matrices(both: DataFrame, most: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """A small set's two matrices on the driver; kernel_scores() takes whole tables."""
    got = both.orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return np.array([r["va"] for r in got]), np.array([r["vb"] for r in got])


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def rbf_cka(x: np.ndarray, y: np.ndarray) -> float:
    def kernel(z: np.ndarray) -> np.ndarray:
        d = _square(z, z)
        s = np.median(d[np.triu_indices(len(z), 1)]) or 1.0
        k = np.exp(-d / (2 * s))
        return k - k.mean(0) - k.mean(1)[:, None] + k.mean()

    a, b = kernel(x), kernel(y)
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def mmd(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased squared maximum mean discrepancy at the pooled median width."""
    z = np.vstack([x, y])
    s = np.median(_square(z, z)[np.triu_indices(len(z), 1)]) or 1.0
    k = lambda p, q: np.exp(-_square(p, q) / (2 * s))
    inner = lambda p: (k(p, p).sum() - len(p)) / (len(p) * (len(p) - 1))
    return float(inner(x) + inner(y) - 2 * k(x, y).mean())


#: Bits of a squared distance's code that a pass tells, and passes: medians are told to 2**-42 of the greatest distance.
BITS, PASSES = 14, 3


def _squares(x: dict, y: dict, a: str, b: str, s: slice, t: slice) -> np.ndarray:
    """A tile of squared distances between column a of x and column b of y."""
    p, q = x[a][s], y[b][t]
    c = p @ q.T
    c *= -2
    c += (p * p).sum(axis=1)[:, None]
    c += (q * q).sum(axis=1)
    return np.maximum(c, 0, out=c)


def _met(own: str, others: list[str]) -> Iterator[tuple]:
    """(x, y, name, first row of x in its file, of y in its, s, t): the tiles of a file and those that it meets."""
    a = 0
    for x in pairs._blocks(pairs._read(own, pairs.BLOCK), pairs.LEFT):
        for name in others:
            b = 0
            for y in pairs._read(name, pairs.BLOCK):
                for t in range(0, len(y["id"]), pairs.BLOCK):
                    for s in range(0, len(x["id"]), pairs.TILE):
                        yield x, y, name, a, b, slice(s, min(s + pairs.TILE, len(x["id"]))), slice(t, min(t + pairs.BLOCK, len(y["id"])))
                b += len(y["id"])
        a += len(x["id"])


def _medians(rows: DataFrame, n: int, top: float) -> tuple[float, float, float]:
    """Medians of the squared distances within each set, and among all items of both, by radix selection over all pairs."""
    within = n * (n - 1) // 2
    sizes = {"x": within, "y": within, "all": 2 * within + n * n}
    ranks = {(k, r): r for k, m in sizes.items() for r in {(m - 1) // 2, m // 2}}
    found = dict.fromkeys(ranks, 0)
    scale = 2.0 ** (BITS * PASSES) / top
    for step in range(PASSES):
        low = BITS * (PASSES - 1 - step)
        prefixes = sorted(set(found.values()))

        def count(own: str, others: list[str], low: int = low, prefixes: list[int] = prefixes) -> Iterator[dict]:
            total = {(k, p): np.zeros(1 << BITS, np.int64) for k in "xyz" for p in prefixes}

            def add(k: str, d: np.ndarray) -> None:
                d = d * scale
                code = np.minimum(d, 2.0 ** (BITS * PASSES) - 1, out=d).astype(np.int64).ravel()
                code >>= low
                for p in prefixes:
                    mine = code if len(prefixes) == 1 and low + BITS == BITS * PASSES else code[(code >> BITS) == p]
                    total[k, p] += np.bincount(mine & ((1 << BITS) - 1), minlength=1 << BITS)

            for x, y, name, a, b, s, t in _met(own, others):
                whole = slice(None)
                if name == own:  # pairs once
                    up = np.arange(a + s.start, a + s.stop)[:, None] < np.arange(b + t.start, b + t.stop)
                    whole = whole if up.all() else up
                    add("z", _squares(x, y, "vec", "other", s, t))
                else:
                    add("z", _squares(x, y, "vec", "other", s, t))
                    add("z", _squares(x, y, "other", "vec", s, t))
                if name != own or up.any():
                    add("x", _squares(x, y, "vec", "vec", s, t)[whole])
                    add("y", _squares(x, y, "other", "other", s, t)[whole])
            for (k, p), h in total.items():
                at = np.flatnonzero(h)
                yield {"k": np.full(len(at), k, object), "p": np.full(len(at), p), "bin": at, "n": h[at]}

        got = pairs.by_halves(rows, count, "k string, p bigint, bin bigint, n bigint").groupBy("k", "p", "bin").agg(F.sum("n").alias("n")).toPandas()  # a row for each bin in use
        for key, rank in list(ranks.items()):
            own = got[(got["p"] == found[key]) & ((got["k"] == key[0]) | (key[0] == "all"))].groupby("bin")["n"].sum().sort_index()
            upto = own.cumsum().to_numpy()
            at = int(np.searchsorted(upto, rank, side="right"))
            ranks[key] = rank - (int(upto[at - 1]) if at else 0)
            found[key] = (found[key] << BITS) + int(own.index[at])
    value = lambda k: np.mean([found[k, r] for r in ((sizes[k] - 1) // 2, sizes[k] // 2)]) / scale or 1.0
    return float(value("x")), float(value("y")), float(value("all"))


def kernel_scores(both: DataFrame) -> tuple[float, float]:
    """(rbf_cka, mmd) of two sets (id, va, vb) over all pairs of items, as rbf_cka() and mmd() have it on matrices.

    Files of items meet in tasks, each two of them once. Centred kernels multiply by their sums, so of every item the two
    kernels' row sums are kept, and no kernel. Needs two items at least; the work is quadratic by nature.
    """
    rows = kept(both.select("id", F.col("va").alias("vec"), F.col("vb").alias("other")))
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(vec.norm(F.col("vec")), vec.norm(F.col("other")))).alias("most")).first()
    n, top = m["n"], (2 * m["most"]) ** 2 or 1.0
    sx, sy, sz = _medians(rows, n, top)
    scalars = ["kl", "kk", "ll", "mx", "my", "mz"]

    def work(own: str, others: list[str]) -> Iterator[dict]:
        ids = {name: np.concatenate([y["id"] for y in pairs._read(name, pairs.BLOCK)] or [np.array([], object)]) for name in others}
        total = {name: np.zeros((2, len(i))) for name, i in ids.items()}
        one = dict.fromkeys(scalars, 0.0)
        kernel = lambda d, s: np.exp(d * (-1 / (2 * s)))
        for x, y, name, a, b, s, t in _met(own, others):
            twice = 1 if name == own else 2
            dx, dy = _squares(x, y, "vec", "vec", s, t), _squares(x, y, "other", "other", s, t)
            k, l = kernel(dx, sx), kernel(dy, sy)  # noqa: E741
            for c, z in enumerate((k, l)):
                total[own][c, a + s.start : a + s.stop] += z.sum(axis=1)
                if name != own:
                    total[name][c, b + t.start : b + t.stop] += z.sum(axis=0)
            for c, p, q in (("kl", k, l), ("kk", k, k), ("ll", l, l)):
                one[c] += twice * float((p * q).sum())
            same = np.arange(a + s.start, a + s.stop)[:, None] == np.arange(b + t.start, b + t.stop) if name == own else None
            for c, d in (("mx", dx), ("my", dy)):
                z = kernel(d, sz)
                one[c] += twice * float(z.sum()) - (float(z[same].sum()) if same is not None else 0.0)
            one["mz"] += float(kernel(_squares(x, y, "vec", "other", s, t), sz).sum())
            if name != own:
                one["mz"] += float(kernel(_squares(x, y, "other", "vec", s, t), sz).sum())
        for name in others:
            yield {"id": ids[name], "rk": total[name][0], "rl": total[name][1], **{c: np.zeros(len(ids[name])) for c in scalars}}
        yield {"id": np.array([None], object), "rk": np.zeros(1), "rl": np.zeros(1), **{c: np.array([v]) for c, v in one.items()}}

    names = ["rk", "rl", *scalars]
    by = pairs.by_halves(rows, work, "id string, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*(F.sum(c).alias(c) for c in names))
    t = by.agg(*(F.sum(c).alias(c) for c in names), F.sum(F.col("rk") * F.col("rl")).alias("rkl"), F.sum(F.col("rk") * F.col("rk")).alias("rkk"), F.sum(F.col("rl") * F.col("rl")).alias("rll")).first()
    centred = lambda raw, by, p, q: raw - 2 * by / n + p * q / (n * n)
    kl, kk, ll = centred(t["kl"], t["rkl"], t["rk"], t["rl"]), centred(t["kk"], t["rkk"], t["rk"], t["rk"]), centred(t["ll"], t["rll"], t["rl"], t["rl"])
    return float(kl / np.sqrt(kk * ll)), float((t["mx"] + t["my"]) / (n * (n - 1)) - 2 * t["mz"] / (n * n))


def energy(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (energy): twice the mean distance across less the mean distances within, diagonals included; 0 at least."""

    def chord(c: np.ndarray) -> np.ndarray:
        c *= -2
        c += 2
        return np.sqrt(np.maximum(c, 0, out=c), out=c)

    p, q = a.count(), b.count()
    mean = lambda x, y, n, name, itself=False: sums(x, y, chord, itself=itself).agg((F.sum("total") / F.lit(float(n))).alias(name))
    parts = mean(a, b, p * q, "xy", True).join(mean(a, a, p * p, "xx")).join(mean(b, b, q * q, "yy"))
    return parts.select(F.greatest(2 * F.col("xy") - F.col("xx") - F.col("yy"), F.lit(0.0)).alias("energy"))

"""Studies of the measures themselves, on corpora of known shape: what they detect, and how surely."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from . import crowding, synthetic

#: Which end of a statistic speaks of crowding.
ALARMS = {
    "mean_cos": "high", "isoscore": "low", "effective_rank": "low", "uniformity": "high", "hub_skew": "high", "knn_q05": "low", "z": "low", "dtm_ratio": "low", "pocket_prominence": "high", "sigma_star": "low", "envelope_p": "low", "lift_off": "high",
}


def chosen_cosines(x: np.ndarray, pairs: int, random: np.random.Generator) -> np.ndarray:
    i, j = random.integers(0, len(x), (2, pairs))
    keep = i != j
    return np.einsum("ij,ij->i", x[i[keep]], x[j[keep]])


def distance_to_measure(x: np.ndarray, share: float) -> np.ndarray:
    k = max(2, int(np.ceil(share * len(x))))
    near = np.partition(-(x @ x.T - 4 * np.eye(len(x))), k - 1, axis=1)[:, :k]
    return np.sqrt(np.maximum(2 + 2 * near, 0).mean(axis=1))


def detectors(x: np.ndarray, pairs: int = 20_000, reps: int = 19, seed: int = 0) -> dict[str, float]:
    """The statistics of ALARMS of one corpus of unit rows that a task can hold."""
    random = np.random.default_rng([seed, 7])
    n, d = x.shape
    cos = chosen_cosines(x, pairs, random)
    e = numeric.eigenvalues(np.cov(x.T))
    g = x @ x.T - 4 * np.eye(n)
    top = np.argpartition(-g, 10, axis=1)[:, :10]
    near = np.take_along_axis(g, top, axis=1)
    dtm = distance_to_measure(x, 0.02)
    found = crowding.pockets(x, 8)
    nulls = [numeric.sphere_cosines(d, pairs, random) for _ in range(reps)]
    chords = np.array([numeric.mean_chord(c) for c in nulls])
    at = np.linspace(-0.5, 1, 61)
    own = numeric.exceedance(cos, at)
    test = numeric.rank_envelope(own, np.array([numeric.exceedance(c, at) for c in nulls]))
    lift = numeric.lift_off(at, own, test["upper"], test["p"], 0.05)
    return {
        "mean_cos": float(cos.mean()), "isoscore": numeric.isoscore(e), "effective_rank": numeric.effective_rank(e), "uniformity": numeric.uniformity(cos), "hub_skew": numeric.skewness(np.bincount(top.ravel(), minlength=n).astype(float)),
        "knn_q05": float(np.quantile(1 - near.mean(axis=1), 0.05)), "z": float((numeric.mean_chord(cos) - chords.mean()) / max(chords.std(), 1e-12)), "dtm_ratio": float(np.quantile(dtm, 0.01) / np.median(dtm)),
        "pocket_prominence": max((p["prominence"] for p in found), default=0.0), "sigma_star": numeric.resolution(cos, n), "envelope_p": float(test["p"]), "lift_off": -1.0 if lift is None else lift,
    }


def _replicated(spark: SparkSession, reps: int, schema: str, one) -> DataFrame:
    """The rows one(rep) of every replicate, a replicate being a task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep in b["id"]:
                yield pd.DataFrame(one(int(rep)))

    return spark.range(0, reps, 1, max(1, min(reps, 2 * spark.sparkContext.defaultParallelism))).mapInPandas(run, schema)


def detection_power(spark: SparkSession, n: int = 600, d: int = 32, nulls: int = 40, planted: int = 10, size: int = 40, spread: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """(statistic, alarm, threshold, power): the share of planted pockets over what `alpha` of uniform corpora reach."""

    def one(rep: int) -> list[dict]:
        x = synthetic.uniform(n, d, rep) if rep < nulls else synthetic.pocketed(n, d, size, spread, seed=rep)
        return [{"planted": rep >= nulls, "statistic": k, "alarm": ALARMS[k], "value": v if ALARMS[k] == "high" else -v} for k, v in detectors(x, 5000, seed=rep).items()]

    rows = _replicated(spark, nulls + planted, "planted boolean, statistic string, alarm string, value double", one)
    cut = rows.where("NOT planted").groupBy("statistic").agg(F.percentile("value", 1 - alpha).alias("cut"))
    told = rows.where("planted").join(F.broadcast(cut), "statistic").groupBy("statistic", "alarm", "cut").agg(F.avg(F.when(F.col("value") > F.col("cut"), 1.0).otherwise(0.0)).alias("power"))
    return told.select("statistic", "alarm", F.when(F.col("alarm") == "high", F.col("cut")).otherwise(-F.col("cut")).alias("threshold"), "power")


def absorption(spark: SparkSession, n: int = 600, d: int = 32, shares: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2), spreads: tuple[float, ...] = (0.02, 0.06), reps: int = 4, inner: int = 19, pairs: int = 5000, alpha: float = 0.05) -> DataFrame:
    """(share, spread, detected, reference): how often the refitted test tells a pocket in a cone, and the tail that the fit itself takes from the pocket."""
    grid = [(f, s) for f in shares for s in spreads]
    at = np.linspace(0.55, 0.95, 25)

    def excess(x: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        random = np.random.default_rng(seed)
        ref = numeric.fitted_cosines(x.mean(axis=0), numeric.square_root(np.cov(x.T)), pairs, random, 1024)
        k = numeric.exceedance(ref, at)
        return float((numeric.exceedance(chosen_cosines(x, pairs, random), at) - k).max()), k

    def one(cell: int) -> list[dict]:
        share, spread = grid[cell // reps]
        x = synthetic.cone(n, d, seed=cell)
        k = max(2, int(share * n))
        x[-k:] = synthetic.pocketed(k, d, k, spread, seed=cell)
        own, ref = excess(x, cell)
        random = np.random.default_rng([cell, 8])
        mean, root, over = x.mean(axis=0), numeric.square_root(np.cov(x.T)), 0
        for b in range(inner):
            y = mean + random.standard_normal((n, d)) @ root.T
            over += excess(y / np.linalg.norm(y, axis=1, keepdims=True), 1000 * cell + b)[0] >= own
        return [{"share": share, "spread": spread, "detected": float((1 + over) / (1 + inner) <= alpha), "reference": float(ref[np.searchsorted(at, 0.85)])}]

    rows = _replicated(spark, len(grid) * reps, "share double, spread double, detected double, reference double", one)
    return rows.groupBy("share", "spread").agg(F.avg("detected").alias("detected"), F.avg("reference").alias("reference"))


def blur_grid(spark: SparkSession, n: int = 2000, d: int = 64, sizes: tuple[int, ...] = (20, 50, 200, 800), shares: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05, 0.1)) -> DataFrame:
    """(size, share, separation, boundary): median distance to measure outside a pocket over that inside; a share beyond the pocket's own, the boundary, blurs it."""

    def one(k: int) -> list[dict]:
        x = synthetic.pocketed(n, d, sizes[k], seed=1)
        out = []
        for m in shares:
            f = distance_to_measure(x, m)
            out.append({"size": sizes[k], "share": m, "separation": float(np.median(f[: -sizes[k]]) / np.median(f[-sizes[k] :])), "boundary": sizes[k] / n})
        return out

    return _replicated(spark, len(sizes), "size int, share double, separation double, boundary double", one)


def z_by_replicates(spark: SparkSession, cos: np.ndarray, d: int, counts: tuple[int, ...] = (8, 16, 24, 48, 96), draws: int = 30) -> DataFrame:
    """(reps, z_mean, z_sd): the occupancy z of pair cosines over `draws` sets of null replicates, by their number."""
    own, pairs = numeric.mean_chord(cos), len(cos)

    def one(cell: int) -> list[dict]:
        reps = counts[cell // draws]
        random = np.random.default_rng([cell, 9])
        null = np.array([numeric.mean_chord(numeric.sphere_cosines(d, pairs, random)) for _ in range(reps)])
        return [{"reps": reps, "z": (own - null.mean()) / max(null.std(), 1e-12)}]

    return _replicated(spark, len(counts) * draws, "reps int, z double", one).groupBy("reps").agg(F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_sd"))


def timed(phases: dict, clock=None) -> list[tuple[str, float]]:
    """(phase, seconds) of callables that return a table, each of which is run to its end."""
    import time

    clock = clock or time.perf_counter
    out = []
    for name, make in phases.items():
        began = clock()
        made = make()
        if isinstance(made, DataFrame):
            made.write.format("noop").mode("overwrite").save()
        out.append((name, clock() - began))
    return out

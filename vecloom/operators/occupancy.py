"""The distribution of pair cosines (t, cos), read at every scale and held against nulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, vec
from .moments import Moments

REPS = 64


def summary(pairs: DataFrame) -> DataFrame:
    c = F.col("cos")
    return pairs.agg(
        F.count(c).alias("n_pairs"), F.avg(c).alias("mean_cos"), F.stddev_pop(c).alias("sd_cos"), F.percentile(c, 0.99).alias("q99"),
        F.ln(F.avg(F.exp(-2 * (2 - 2 * c)))).alias("uniformity"), F.avg(vec.chord(c)).alias("mean_chord"),
    )


def grid(spark: SparkSession, lo: float, hi: float, points: int, name: str = "t") -> DataFrame:
    step = (hi - lo) / (points - 1)
    return spark.range(points).select(F.col("id").alias("k"), (F.lit(lo) + F.col("id") * step).alias(name))


def exceedance(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """(k, t, share): of pairs with cos >= t. Pairs are counted into the grid's cells in one pass."""
    points = [(r["k"], r["t"]) for r in at.orderBy("t").collect()]
    steps = np.array([t for _, t in points])
    below = F.aggregate(F.array(*(F.lit(float(t)) for t in steps)), F.lit(0), lambda m, t: m + F.when(F.col("cos") >= t, 1).otherwise(0))
    counts = np.zeros(len(points) + 1)
    for r in pairs.select(below.alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each cell
        counts[r["m"]] = r["n"]
    share = counts[::-1].cumsum()[::-1][1:] / max(1.0, counts.sum())
    return at.sparkSession.createDataFrame([(k, float(t), float(s)) for (k, t), s in zip(points, share, strict=True)], "k bigint, t double, share double")


def collisions(pairs: DataFrame, n: Column | int, sigmas: list[float]) -> DataFrame:
    """(sigma, expected): collisions that an item of n expects under noise of each width."""
    wide = pairs.select("cos", F.explode(F.array(*(F.lit(float(s)) for s in sigmas))).alias("sigma"))
    long = wide.select("sigma", vec.confusion(F.col("cos"), F.col("sigma")).alias("phi"))
    return long.groupBy("sigma").agg(((F.lit(n) - 1) * F.avg("phi")).alias("expected"))


def structured_collisions(pairs: DataFrame, covariance: np.ndarray) -> DataFrame:
    """pairs (va, vb, ...) with phi, the confusion under Gaussian noise of that covariance S: with u = vb - va
    the normal distribution at -(u'u / 2) / sqrt(u'Su)."""
    u = F.zip_with("vb", "va", lambda a, b: a - b)
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in covariance))
    own = pairs.withColumn("_u", u)
    su = F.transform(rows, lambda r: vec.dot(r, F.col("_u")))
    var = F.greatest(vec.dot(F.col("_u"), su), F.lit(1e-30))
    return own.withColumn("phi", vec.normal_cdf(-(vec.dot(F.col("_u"), F.col("_u")) / 2) / F.sqrt(var))).drop("_u")


def cosines(pairs: DataFrame) -> np.ndarray:
    """The bounded sample, on the driver, in the order of its draws."""
    return np.array([r["cos"] for r in pairs.orderBy("t").select("cos").collect()])


def resolution(cos: np.ndarray, n: int, wanted: float = 1.0) -> float:
    return numeric.resolution(cos, n, wanted)


def _tasks(spark: SparkSession, reps: int) -> int:
    return max(1, min(reps, 2 * spark.sparkContext.defaultParallelism))


def null_curves(spark: SparkSession, fit: Moments, pairs: int, at: np.ndarray, reps: int, kind: str = "fitted", seed: int = 0) -> DataFrame:
    """(rep, mean_chord, curve): replicates of a null, each a task's work. kind: "uniform", "spectrum" (mean zero) or "fitted"."""
    mean, d = (fit.mean if kind == "fitted" else 0 * fit.mean), fit.dim
    root = None if kind == "uniform" else numeric.square_root(fit.cov)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep in b["id"]:
                random = np.random.default_rng([seed, int(rep)])
                c = numeric.sphere_cosines(d, pairs, random) if kind == "uniform" else numeric.fitted_cosines(mean, root, pairs, random)
                yield pd.DataFrame({"rep": [rep], "mean_chord": [numeric.mean_chord(c)], "curve": [numeric.exceedance(c, at).tolist()]})

    return spark.range(0, reps, 1, _tasks(spark, reps)).mapInPandas(run, "rep bigint, mean_chord double, curve array<double>")


def density(values: DataFrame, value: str, at: list[float], width: Column, by: list[str] = ()) -> DataFrame:
    """(by ..., x, density): the mean of Gaussian kernels at each x; width: a column of the rows."""
    x = values.select(*by, value, width.alias("_w"), F.explode(F.array(*map(F.lit, at))).alias("x"))
    z = (F.col("x") - F.col(value)) / F.col("_w")
    return x.groupBy(*by, "x").agg(F.avg(F.exp(-z * z / 2) / (F.col("_w") * math.sqrt(2 * math.pi))).alias("density"))


def envelope(curves: DataFrame) -> DataFrame:
    """(k, upper, mean) of the null curves."""
    long = curves.select(F.posexplode("curve").alias("k", "v"))
    return long.groupBy("k").agg(F.max("v").alias("upper"), F.avg("v").alias("mean"))


def occupancy_z(value: float, nulls: DataFrame) -> DataFrame:
    """One row: z of the mean chord against the replicates (population sd, 1e-12 at least)."""
    m = nulls.agg(F.avg("mean_chord").alias("null_mean"), F.greatest(F.stddev_pop("mean_chord"), F.lit(1e-12)).alias("null_sd"), F.count(F.lit(1)).alias("reps"))
    return m.withColumn("z", (F.lit(value) - F.col("null_mean")) / F.col("null_sd"))


def rank_test(cos: np.ndarray, nulls: DataFrame, at: np.ndarray, alpha: float = 0.05) -> dict:
    """p, reps and lift-off of the data's curve among the null curves (reps x grid, on the driver)."""
    curves = np.array([r["curve"] for r in nulls.orderBy("rep").collect()])
    own = numeric.exceedance(cos, at)
    got = numeric.rank_envelope(own, curves, alpha)
    return {"p": got["p"], "reps": got["reps"], "lift_off": numeric.lift_off(at, own, got["upper"], got["p"], alpha), "pointwise_lift_off": numeric.lift_off(at, own, curves.max(axis=0))}


def refit_bootstrap(spark: SparkSession, cos: np.ndarray, fit: Moments, at: float, reps: int, rows: int = 4096, seed: int = 0) -> tuple[float, float, int]:
    """(excess, p, reps): share of pairs at or above `at` less that of the fit; replicates refit their own mean and covariance."""
    mean, cov, pairs, n = fit.mean, fit.cov, len(cos), min(rows, max(2, fit.n))

    def excess(c: np.ndarray, mu: np.ndarray, sigma: np.ndarray, random: np.random.Generator) -> float:
        return float((c >= at).mean() - (numeric.fitted_cosines(mu, numeric.square_root(sigma), pairs, random) >= at).mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = numeric.square_root(cov)
        for b in batches:
            out = []
            for rep in b["id"]:
                random = np.random.default_rng([seed, int(rep)])
                x = mean + random.standard_normal((n, len(cov))) @ root.T
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                i, j = random.integers(0, n, (2, pairs))
                c = np.einsum("ij,ij->i", x[i[i != j]], x[j[i != j]])
                out.append(excess(c, x.mean(axis=0), np.cov(x.T), random))
            yield pd.DataFrame({"e": out})

    own = excess(cos, mean, cov, np.random.default_rng([seed, reps]))
    more = spark.range(0, reps, 1, _tasks(spark, reps)).mapInPandas(run, "e double").where(F.col("e") >= own).count()
    return own, (1 + more) / (1 + reps), reps

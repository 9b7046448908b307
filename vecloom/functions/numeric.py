"""Numerics on bounded arrays: spectra, samples of pair cosines, curves. numpy only."""

from __future__ import annotations

import math

import numpy as np


#: 7.1.26 of Abramowitz and Stegun: p, then the coefficients from the highest power down.
RATIONAL = (0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0))


def erf(x: np.ndarray) -> np.ndarray:
    size = np.abs(x)
    tail = np.polyval(RATIONAL[1], 1 / (1 + RATIONAL[0] * size)) * np.exp(-(size**2))
    return np.copysign(1 - tail, x)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def confusion(cos: np.ndarray, sigma: float) -> np.ndarray:
    """The chance that noise of width sigma swaps two unit vectors, normal_cdf(-chord / (2 sigma)). Overwrites cos."""
    z = cos
    z *= -1 / (4 * sigma * sigma)
    z += 1 / (4 * sigma * sigma)
    np.maximum(z, 0, out=z)
    t = np.sqrt(z)
    t *= RATIONAL[0]
    t += 1
    np.divide(1, t, out=t)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z *= 0.5
    tail = t * RATIONAL[1][0]
    for c in RATIONAL[1][1:-1]:
        tail += c
        tail *= t
    z *= tail
    return z


def normal_quantile(p: float) -> float:
    """By bisection of the exact distribution function."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


# spectra: eigenvalues in descending order


def eigenvalues(cov: np.ndarray) -> np.ndarray:
    return np.clip(np.linalg.eigvalsh(cov), 0, None)[::-1]


def effective_rank(eigs: np.ndarray) -> float:
    s = np.sqrt(eigs[eigs > 0])
    if not len(s):
        return 0.0
    p = s / s.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def participation_ratio(eigs: np.ndarray) -> float:
    square = float((eigs**2).sum())
    return float(eigs.sum() ** 2 / square) if square else 0.0


def dims_for(eigs: np.ndarray, share: float) -> int:
    total = eigs.sum()
    return int(np.searchsorted(np.cumsum(eigs) / total, share - 1e-12) + 1) if total else 0


def isoscore_parts(eigs: np.ndarray) -> dict[str, float]:
    d = len(eigs)
    length = np.linalg.norm(eigs)
    if d < 2 or not length:
        return {"defect": 1.0, "isotropic_dims": 1.0, "score": 0.0}
    v = math.sqrt(d) * eigs / length
    defect = float(np.linalg.norm(v - 1) / math.sqrt(2 * (d - math.sqrt(d))))
    dims = (d - defect**2 * (d - math.sqrt(d))) ** 2 / d
    return {"defect": defect, "isotropic_dims": dims, "score": float(np.clip((dims - 1) / (d - 1), 0, 1))}


def isoscore(eigs: np.ndarray) -> float:
    return isoscore_parts(eigs)["score"]


def shrunk_isoscore(eigs: np.ndarray, n: int) -> float:
    """IsoScore of eigenvalues drawn towards their mean, as few rows allow."""
    d = len(eigs)
    zeta = float(np.clip(1 - min(n - 1, d) / d, 0, 0.95))
    return isoscore((1 - zeta) * eigs + zeta * eigs.mean())


# pair cosines


def exceedance(cos: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Share of pairs at or above each grid value."""
    s = np.sort(cos)
    return 1 - np.searchsorted(s, grid, side="left") / len(s)


def mean_chord(cos: np.ndarray) -> float:
    return float(np.sqrt(np.maximum(2 - 2 * cos, 0)).mean())


def uniformity(cos: np.ndarray, t: float = 2.0) -> float:
    return float(np.log(np.exp(-t * (2 - 2 * cos)).mean()))


def sphere_uniformity(d: int, t: float = 2.0) -> float:
    """log E exp(-t |x - y|^2) of independent uniform directions: exp(-2t) times a Bessel series in 2t."""
    term, total, k = 1.0, 0.0, 0
    while term > 1e-18 * total:
        total += term
        k += 1
        term *= t * t / (k * (d / 2 + k - 1))
    return -2 * t + math.log(total)


def expected_collisions(cos: np.ndarray, n: int, sigma: float) -> float:
    return float((n - 1) * normal_cdf(-np.sqrt(np.maximum(2 - 2 * cos, 0)) / (2 * sigma)).mean())


def resolution(cos: np.ndarray, n: int, wanted: float = 1.0) -> float:
    """sigma*: the noise width at which an item expects `wanted` collisions, between 0.001 and 3."""
    lo, hi = 1e-3, 3.0
    if expected_collisions(cos, n, lo) >= wanted:
        return lo
    if expected_collisions(cos, n, hi) <= wanted:
        return hi
    for _ in range(60):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if expected_collisions(cos, n, mid) < wanted else (lo, mid)
    return math.sqrt(lo * hi)


def sphere_cosines(d: int, pairs: int, random: np.random.Generator) -> np.ndarray:
    """Cosines of independent uniform directions, by their Beta law."""
    return 2 * random.beta((d - 1) / 2, (d - 1) / 2, pairs) - 1


def square_root(cov: np.ndarray) -> np.ndarray:
    """R with R R' = cov."""
    values, vectors = np.linalg.eigh(cov)
    return vectors * np.sqrt(np.clip(values, 0, None))


def fitted_cosines(mean: np.ndarray, root: np.ndarray, pairs: int, random: np.random.Generator, rows: int = 4096) -> np.ndarray:
    """Cosines of pairs drawn from a Gaussian fit (mean, square_root()), at unit length; mean 0 leaves only the spectrum."""
    x = mean + random.standard_normal((rows, len(root))) @ root.T
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    i, j = random.integers(0, rows, (2, pairs))
    keep = i != j
    return np.einsum("ij,ij->i", x[i[keep]], x[j[keep]])


def rank_envelope(data: np.ndarray, nulls: np.ndarray, alpha: float = 0.05) -> dict:
    """Extreme-rank-length test of a curve against null curves (rows), for large values.

    Each curve's ranks over the grid (1: the largest there) are sorted; curves compare by them as
    words do, so the most extreme has the smallest. p counts the nulls as extreme as the data. The
    critical envelope is what the nulls reach without the floor(alpha * (n + 1)) most extreme.
    """
    every = np.vstack([data, nulls])
    ranks = np.empty(every.shape, np.int64)
    for t in range(every.shape[1]):
        column = np.sort(every[:, t])
        ranks[:, t] = len(column) - np.searchsorted(column, every[:, t], side="right") + 1
    words = np.sort(ranks, axis=1)
    own = tuple(words[0])
    extreme = sum(tuple(w) <= own for w in words[1:])
    order = sorted(range(len(nulls)), key=lambda k: tuple(words[k + 1]))
    kept = order[int(alpha * (len(nulls) + 1)) :]
    upper = nulls[kept].max(axis=0)
    return {"p": (1 + extreme) / (len(nulls) + 1), "upper": upper, "reps": len(nulls)}


def lift_off(grid: np.ndarray, curve: np.ndarray, upper: np.ndarray, p: float = 0.0, alpha: float = 1.0) -> float | None:
    """The highest grid value at which the curve leaves the envelope; None if it doesn't or p says no."""
    above = np.flatnonzero(curve > upper)
    return float(grid[above[-1]]) if len(above) and p <= alpha else None


def skewness(x: np.ndarray) -> float:
    """Of a population; a constant has 0."""
    sd = x.std() or 1.0
    return float((((x - x.mean()) / sd) ** 3).mean())


def binomial_tail(k: int, n: int) -> float:
    """Two-sided exact sign test of k successes in n fair draws, at most 1.

    The tail is summed from its largest term down, each by its ratio to the one before; what is left
    out lies below 1e-18 of the sum, so some multiples of sqrt(n) terms are enough.
    """
    k = min(k, n - k)
    if not n or 2 * k >= n:
        return 1.0
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-18 * total:
            break
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * total * math.exp(min(0.0, first)))


def adjusted_rand(table: np.ndarray) -> float:
    """Of a contingency table of two clusterings."""
    pairs = lambda x: (x * (x - 1) / 2).sum()
    total, both = pairs(np.array([table.sum()])), pairs(table)
    a, b = pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    expected = a * b / total if total else 0.0
    top = (a + b) / 2
    return float((both - expected) / (top - expected)) if top != expected else 1.0

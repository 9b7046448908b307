"""The cutting-stock problem by column generation: a linear program over patterns of lengths."""

from __future__ import annotations

import numpy as np


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern: counts of each length (ascending) within capacity, of most value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            worth = values[:k] + best[c - lengths[:k]]
            j = int(worth.argmax())
            if worth[j] > best[c] + 1e-12:
                best[c], took[c] = worth[j], j
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), counts


def column_generation(demand: dict[int, int], capacity: int, gap: float = 5e-4, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(pattern, how often) of the relaxed problem: as few whole lengths as possible meet demand.

    Revised simplex over one row per length; the knapsack prices columns. A best price of v
    proves the basis within a factor v of the optimum: below 1 + gap it ends. Any step's basis
    meets the demand, so stopping after `most` columns loses optimality only.
    """
    lengths = np.array(sorted(demand))
    d = np.array([demand[n] for n in lengths], float)
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1 / np.maximum(capacity // lengths, 1)) if m else basis
    x = (inverse * d).sum(axis=1)
    for _ in range(most):
        if not m:
            break
        value, pattern = knapsack(lengths, inverse.sum(axis=0), capacity)
        if value <= 1 + gap:
            break
        into = sum(inverse[:, j] * pattern[j] for j in np.flatnonzero(pattern))
        ratio = np.where(into > 1e-10, x / np.where(into > 1e-10, into, 1), np.inf)
        r = int(ratio.argmin())
        x = x - ratio[r] * into
        x[r] = ratio[r]
        x = np.maximum(x, 0)
        basis[:, r] = pattern
        row = inverse[r] / into[r]
        inverse = inverse - np.outer(into, row)
        inverse[r] = row
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(m)]


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern {length: count}, times): patterns that use up the demand exactly.

    The relaxed solution is rounded down; what is left goes by first fit decreasing.
    """
    demand = {n: k for n, k in demand.items() if k > 0}
    lengths = sorted(demand)
    left = dict(demand)
    out: list[tuple[dict[int, int], int]] = []
    for pattern, often in column_generation(demand, capacity):
        used = {lengths[i]: int(k) for i, k in enumerate(pattern) if k}
        times = min([int(often + 1e-6), *(left[n] // k for n, k in used.items())])
        if times > 0:
            out.append((used, times))
            for n, k in used.items():
                left[n] -= k * times
    bins: list[tuple[int, dict[int, int]]] = []
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            for i, (room, own) in enumerate(bins):
                if room >= n:
                    own[n] = own.get(n, 0) + 1
                    bins[i] = (room - n, own)
                    break
            else:
                bins.append((capacity - n, {n: 1}))
    return out + [(own, 1) for _, own in bins]

"""Corpora of known shape, for studies of what the measures detect: unit vectors from a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def uniform(n: int, d: int, seed: int = 0) -> np.ndarray:
    return _unit(np.random.default_rng([seed, 1]).standard_normal((n, d)))


def pocketed(n: int, d: int, size: int, spread: float = 0.02, count: int = 1, seed: int = 0) -> np.ndarray:
    """Uniform directions whose last count * size rows lie about `count` centres, size rows each."""
    random = np.random.default_rng([seed, 2])
    x = uniform(n, d, seed)
    for k in range(count):
        rows = slice(n - (k + 1) * size, n - k * size)
        x[rows] = _unit(x[rows.start] + spread * random.standard_normal((size, d)))
    return x


def cone(n: int, d: int, strength: float = 0.577, seed: int = 0) -> np.ndarray:
    """Directions that share a mean."""
    random = np.random.default_rng([seed, 3])
    axis = _unit(random.standard_normal((1, d)))
    return _unit(strength * np.sqrt(d) * axis + random.standard_normal((n, d)))


def ellipse(n: int, d: int, axes: int = 8, factor: float = 6.0, seed: int = 0) -> np.ndarray:
    """Mean zero, wider along the first axes."""
    scale = np.ones(d)
    scale[:axes] = factor
    return _unit(np.random.default_rng([seed, 4]).standard_normal((n, d)) * scale)


def low_rank(n: int, d: int, rank: int, seed: int = 0) -> np.ndarray:
    random = np.random.default_rng([seed, 5])
    return _unit(random.standard_normal((n, rank)) @ random.standard_normal((rank, d)))


def mixture(n: int, d: int, groups: int, spread: float = 0.3, seed: int = 0) -> np.ndarray:
    """Equal groups about random centres; row i belongs to group i mod groups."""
    random = np.random.default_rng([seed, 6])
    centre = _unit(random.standard_normal((groups, d)))
    return _unit(centre[np.arange(n) % groups] + spread * random.standard_normal((n, d)))


def table(spark: SparkSession, x: np.ndarray, labels: list | None = None) -> DataFrame:
    """(id, vec, label) of rows of an array."""
    rows = [(i, v.tolist(), None if labels is None else str(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label string")

"""Where the modules of this package put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Decimals that both sides round to.
DIGITS = 6

#: Common table expressions of the SQL side: unit vectors, all pairs, neighbours, sampled pairs.
UNIT = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)"""
PAIRS = UNIT + """, p AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id)"""
NEAR = PAIRS + """, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS r FROM p)"""
DRAWN = UNIT + """, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS m FROM u),
t AS (SELECT t, (t * 7919 + 13) % m AS i, (t * 104729 + t * t * 31 + 7) % m AS j FROM range(20000) x(t), (SELECT count(*) AS m FROM u)),
s AS (SELECT t, a.id AS a, b.id AS b, a.label AS la, b.label AS lb, a.m, list_dot_product(a.v, b.v) AS c FROM t JOIN r a ON a.n = t.i JOIN r b ON b.n = t.j WHERE t.i <> t.j)"""
DRAWS = 20_000


def mixed(c: str, seed: int = 0) -> str:
    """The SQL of sampling.mixed()."""
    return f"md5(CAST({c} AS VARCHAR) || ':{seed}')"


def phi(cosine: str, sigma: str) -> str:
    """The SQL of the confusion of a pair of cosine `cosine` under noise `sigma`."""
    z = f"(sqrt(greatest(2 - 2 * {cosine}, 0)) / (2 * {sigma}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    return f"(0.5 * {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{z} * {z}))"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def r6(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, zero without a sign."""
    x = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label) of the embeddings, as given."""
    return schema.vectors(table(spark, sf_dir, "embeddings"), schema.Columns("embedding", "vec_id", "label"))


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.unit(raw(spark, sf_dir))

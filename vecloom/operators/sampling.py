"""Samples that don't depend on partitions or on the order of rows: rows are taken by the MD5 of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from .order import numbered

SIZE, PAIRS = 20_000, 200_000
#: Rows of a group's histogram of hashes: by the first three hexadecimal digits.
DIGITS, BUCKETS = 3, 4096


def mixed(id: Column, seed: int = 0) -> Column:
    """32 hexadecimal digits that scatter ids evenly; any SQL engine gives the same."""
    return F.md5(F.concat(id.cast("string"), F.lit(f":{seed}")))


def fraction(id: Column, seed: int = 0) -> Column:
    """A number from 0 to 1, exclusive, of an id: the first 48 bits of mixed()."""
    return (F.conv(F.substring(mixed(id, seed), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def sample(rows: DataFrame, size: int = SIZE, seed: int = 0, id: str = "id") -> DataFrame:
    """`size` rows, those of least mixed id: any row is as likely as any other."""
    return rows.orderBy(mixed(F.col(id), seed), id).limit(size)


def pair_ranks(n: int, pairs: int, spark) -> DataFrame:
    """(t, i, j), i <> j: pairs of ranks below n, spread by arithmetic."""
    t = F.col("id")
    i = F.pmod(t * 7919 + 13, F.lit(n))
    j = F.pmod(t * 104729 + t * t * 31 + 7, F.lit(n))
    return spark.range(pairs).select(t.alias("t"), i.alias("i"), j.alias("j")).where("i <> j")


def pair_vectors(rows: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(t, a, b, la, lb, va, vb): `pairs` pairs drawn from all unit rows (id, vec, label).

    Only ids are ordered; of the vectors those of the pairs are fetched, so the draw's size bounds them.
    """
    ids = rows.select("id")
    drawn = F.broadcast(pair_ranks(max(1, ids.count()), pairs, rows.sparkSession))
    ranked = numbered(ids, ["id"], "r")
    met = drawn.join(ranked.select(F.col("r").alias("i"), F.col("id").alias("a")), "i").join(ranked.select(F.col("r").alias("j"), F.col("id").alias("b")), "j")
    side = lambda n: rows.select(F.col("id").alias(n), F.col("label").alias(f"l{n}"), F.col("vec").alias(f"v{n}"))
    return met.select("t", "a", "b").join(side("a"), "a").join(side("b"), "b").select("t", "a", "b", "la", "lb", "va", "vb")


def pair_cosines(rows: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(t, a, b, la, lb, cos) of pair_vectors()."""
    return pair_vectors(rows, pairs).select("t", "a", "b", "la", "lb", vec.dot(F.col("va"), F.col("vb")).alias("cos"))


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int | Column) -> DataFrame:
    """The first `cap` rows of every group."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_r", r).where(F.col("_r") <= cap).drop("_r")


def taken(rows: DataFrame, by: list[str], quota: Column, id: str, seed: int = 0, out: str = "taken") -> DataFrame:
    """rows with `out`: whether a row is among the quota of its group that has the least mixed ids.

    quota: an expression over the group's size `n` and `by`. A histogram of the hashes tells in which of 4096
    buckets a group's quota ends; only that bucket's rows are ranked, so no task holds a group.
    """
    h = mixed(F.col(id), seed)
    marked = rows.withColumns({"_h": h, "_bucket": F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int")})
    counts = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    upto = counts.withColumns({"_upto": F.sum("_c").over(group.orderBy("_bucket")), "n": F.sum("_c").over(group)}).withColumn("_quota", F.least(quota, F.col("n")).cast("bigint"))
    ends = upto.where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_c") < F.greatest("_quota", F.lit(1)))).select(*by, F.col("_bucket").alias("_end"), (F.col("_quota") - F.col("_upto") + F.col("_c")).alias("_left"))
    ends = ends.toDF(*(f"_by{i}" for i in range(len(by))), "_end", "_left")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    told = marked.join(F.broadcast(ends) if ends.limit(10_001).count() <= 10_000 else ends, same, "left").drop(*(f"_by{i}" for i in range(len(by))))
    sure = told.where("_bucket <> _end").withColumn(out, F.col("_bucket") < F.col("_end"))
    last = told.where("_bucket = _end").withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("_h", id)) <= F.col("_left"))
    return sure.union(last).drop("_h", "_bucket", "_end", "_left")


def split(rows: DataFrame, by: list[str], share: float, id: str = "id", seed: int = 0) -> DataFrame:
    """rows with `part`: "eval" for round(n * share) rows of each group, "train" for the others."""
    out = taken(rows, by, F.floor(F.col("n") * share + 0.5), id, seed, "_held")
    return out.withColumn("part", F.when(F.col("_held"), "eval").otherwise("train")).drop("_held")


def stratified(rows: DataFrame, by: str, size: int, held: float = 0.2, id: str = "id") -> DataFrame:
    """A sample in proportion to the strata, whose rounding goes to the largest; with `part` by split()."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each stratum
    total = sum(counts.values())
    quota = {k: int(n * size / total + 0.5) for k, n in counts.items()}
    if quota:
        first = min(counts, key=lambda k: (-counts[k], k is None, k))
        quota[first] += size - sum(quota.values())
    which = F.coalesce(*(F.when(F.col(by).eqNullSafe(F.lit(k)), F.lit(q)) for k, q in quota.items()), F.lit(0))
    kept = taken(rows, [by], which, id, 0, "_in").where("_in").drop("_in")
    return split(kept, [by], held, id, seed=1)


def weighted(rows: DataFrame, weight: str, size: int, id: str = "id") -> DataFrame:
    """Without replacement, in proportion to weight: the least -ln(u) / weight, u from the id."""
    return rows.where(F.col(weight) > 0).orderBy(-F.ln(fraction(F.col(id))) / F.col(weight), id).limit(size)


def rebalanced(rows: DataFrame, kind: str, many: str, id: str = "id") -> DataFrame:
    """Rows of the kind `many`, and at most twice as many others, so that they are a third."""
    cap = 2 * rows.where(F.col(kind) == many).count()
    marked = rows.withColumn("_many", F.coalesce(F.col(kind) == many, F.lit(False)))
    return taken(marked, ["_many"], F.when(F.col("_many"), F.col("n")).otherwise(F.lit(cap)), id, 0, "_in").where("_in").drop("_many", "_in")

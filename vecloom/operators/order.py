"""Running sums and row numbers over a whole table's order, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept

#: Rows up to which one task orders all: narrow ones, so some tens of MB.
ONE_TASK = 1_000_000


def before(rows: DataFrame, order: list[Column | str], value: Column | str, out: str = "before", most: int = ONE_TASK) -> DataFrame:
    """rows with the sum of `value` over the rows that come before in the order, which must be total.

    Longer tables are divided into ranges of the order; the table of the ranges' sums (as many rows as
    there are shuffle partitions) gives each range its start.
    """
    c = F.col(value) if isinstance(value, str) else value
    zero = F.lit(0)
    if rows.limit(most + 1).count() <= most:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(c).over(w), zero))
    spark = rows.sparkSession
    parts = max(4, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = kept(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.sum(c).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(w), zero)).drop("_sum")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum(c).over(own), zero)).join(F.broadcast(starts), "_range")
    return summed.withColumn(out, F.col("_own") + F.col("_start")).drop("_range", "_own", "_start")


def numbered(rows: DataFrame, order: list[Column | str], out: str, most: int = ONE_TASK) -> DataFrame:
    """rows numbered from 0 in a total order."""
    return before(rows, order, F.lit(1), out, most).withColumn(out, F.col(out).cast("bigint"))


def quantiles(rows: DataFrame, value: str, at: list[float], most: int = ONE_TASK) -> list[float | None]:
    """Exact quantiles with linear interpolation; of many rows by their places in the order, not by one task's table of values."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    if known.limit(most + 1).count() <= most:
        return known.agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).first()["q"] or [None] * len(at)
    counts = kept(before(known.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], "n", "b", most))
    n = counts.agg(F.sum("n")).first()[0]
    wanted = sorted({int(q * (n - 1)) + k for q in at for k in (0, 1)})
    hit = counts.select("v", "b", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda p: (p >= F.col("b")) & (p < F.col("b") + F.col("n")))).alias("p"))
    value_at = {r["p"]: r["v"] for r in hit.collect()}
    out = []
    for q in at:
        low = int(q * (n - 1))
        part = q * (n - 1) - low
        out.append(value_at[low] + (part * (value_at[low + 1] - value_at[low]) if part else 0.0))
    return out

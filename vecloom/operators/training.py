"""What a training loop takes from an embedding: values of losses, weights, guarded pairs, negatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from .order import numbered
from .sampling import mixed


def pair_table(rows: DataFrame) -> DataFrame:
    """(i, j, cos) of all ordered pairs of a batch of unit rows."""
    from .pairs import at_least

    up = at_least(rows, -2.0).select(F.col("a").alias("i"), F.col("b").alias("j"), "cos")
    return up.union(up.select("j", "i", "cos"))


def batched_pairs(rows: DataFrame, size: int, part: str | None = None) -> DataFrame:
    """(batch[, part], i, j, cos) of all ordered pairs of every batch of unit rows: batch k holds the ids from k * size to (k + 1) * size - 1.

    part: a boolean column that divides every batch in two.
    """
    kind = rows.schema["id"].dataType.simpleString()
    keys = ["batch"] + ([part] if part else [])

    def pairs(x: pd.DataFrame) -> pd.DataFrame:
        v, id = np.stack(x["vec"].to_list()), x["id"].to_numpy()
        i, j = np.nonzero(id[:, None] != id[None, :])
        return pd.DataFrame({**{k: x[k].iloc[0] for k in keys}, "i": id[i], "j": id[j], "cos": (v @ v.T)[i, j]})

    dealt = rows.select(F.floor(F.col("id") / size).cast("bigint").alias("batch"), *keys[1:], "id", "vec")
    extra = f"{part} boolean, " if part else ""
    return dealt.groupBy(*keys).applyInPandas(pairs, f"batch bigint, {extra}i {kind}, j {kind}, cos double")


def batched_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, cos, rank): the pairs of batched_pairs() as ranked edges, ties by id."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("cos").desc(), "j"))
    return pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), "cos", rank.alias("rank"))


def guarded(edges: DataFrame, top: int) -> DataFrame:
    """(i, j): pairs of which either has the other among its first `top` neighbours."""
    near = edges.where(F.col("rank") <= top)
    return near.select(F.col("src").alias("i"), F.col("dst").alias("j")).union(near.select(F.col("dst").alias("i"), F.col("src").alias("j"))).distinct()


def confusion_loss(pairs: DataFrame, sigma: float, guard: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (loss), or one for each value of `by`: the mean confusion of the pairs that the guard doesn't hold back."""
    kept = pairs if guard is None else pairs.join(guard, ["i", "j"], "left_anti")
    c = F.sqrt(F.greatest(2 - 2 * F.col("cos"), F.lit(1e-12)))
    return kept.groupBy(*by).agg(F.avg(vec.normal_cdf(-c / (2.0 * sigma))).alias("loss"))


def uniformity_loss(pairs: DataFrame, t: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.ln(F.avg(F.exp(-t * (2 - 2 * F.col("cos"))))).alias("loss"))


def preservation_loss(before: DataFrame, after: DataFrame, temperature: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (loss), or one for each value of `by`: mean over rows of the divergence of the old neighbour softmax from the new."""

    def log_softmax(p: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("i")
        z = p.withColumn("z", F.col("cos") / temperature).withColumn("m", F.max("z").over(w))
        return z.select(*by, "i", "j", (F.col("z") - F.col("m") - F.ln(F.sum(F.exp(F.col("z") - F.col("m"))).over(w))).alias(name))

    both = log_softmax(before, "old").join(log_softmax(after, "new"), [*by, "i", "j"])
    return both.groupBy(*by, "i").agg(F.sum(F.exp("old") * (F.col("old") - F.col("new"))).alias("kl")).groupBy(*by).agg(F.avg("kl").alias("loss"))


def resolution_weights(collisions: DataFrame, floor: float = 0.1) -> DataFrame:
    """(id, weight): the collisions' shares, mixed with equal ones by `floor`, adding up to 1."""
    total = collisions.agg(F.sum("collisions").alias("s"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("s") > 0, (1 - floor) * F.col("collisions") / F.col("s")).otherwise((1 - floor) / F.col("n")) + F.lit(floor) / F.col("n")
    return collisions.join(F.broadcast(total)).select("id", share.alias("weight"))


def confusable_negatives(pairs: DataFrame, guard: DataFrame, lo: float, hi: float, each: int) -> DataFrame:
    """(i, j, cos): up to `each` pairs of every anchor whose cosine lies in the window, guarded ones left out."""
    if lo >= hi:
        raise ValueError("the window's lower end must be below its upper end")
    kept = pairs.where(F.col("cos").between(lo, hi)).join(guard, ["i", "j"], "left_anti")
    order = Window.partitionBy("i").orderBy(mixed(F.col("j")), "j")
    return kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).drop("_r")


def hard_negatives(near: DataFrame, gold: DataFrame, each: int) -> DataFrame:
    """(q, id, rank): each query's nearest (q, id, cos) without any of its golds (q, id)."""
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cos").desc(), "id"))
    return near.join(gold, ["q", "id"], "left_anti").withColumn("rank", r).where(F.col("rank") <= each)


def first_wrong(hits: DataFrame, each: int) -> DataFrame:
    """(q, id, rank): the nearest of hits (q, id, cos, rel) that aren't relevant, ranked anew."""
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cos").desc(), "id"))
    return hits.where("NOT rel").withColumn("rank", r).where(F.col("rank") <= each)


def other_groups(rows: DataFrame, each: int) -> DataFrame:
    """(q, id, text): for every group q the `each` rows of least id of other groups.

    They are among the `each` least of each group, so only those meet.
    """
    r = F.row_number().over(Window.partitionBy("q").orderBy("id", "text"))
    least = rows.where("q IS NOT NULL").withColumn("_r", r).where(F.col("_r") <= each).drop("_r")
    met = rows.where("q IS NOT NULL").select("q").distinct().join(least.withColumnRenamed("q", "_o"), F.col("q") != F.col("_o"))
    again = F.row_number().over(Window.partitionBy("q").orderBy("id", "text"))
    return met.withColumn("_r", again).where(F.col("_r") <= each).select("q", "id", "text")


def training_rows(positives: DataFrame, negatives: DataFrame, n_positive: int = 3, n_negative: int = 5) -> DataFrame:
    """(q, anchor, positives, negatives, gold_numbers): ordered, cut, the last one repeated to fill."""
    numbers = numbered(positives.select("id").distinct(), ["id"], "number")

    def gathered(x: DataFrame, what: str, n: int, name: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("q").orderBy("id", what))  # cut before they are gathered: a q may have any number of rows
        first = x.select("q", "id", what).distinct().withColumn("_r", r).where(F.col("_r") <= n)
        got = first.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", what))), lambda s: s[what]).alias("g"))
        last = F.element_at("g", -1)
        return got.select("q", F.concat("g", F.array_repeat(last, F.lit(n) - F.size("g"))).alias(name))

    p = positives.join(numbers, "id")
    anchors = positives.groupBy("q").agg(F.min("question").alias("anchor"))
    out = anchors.join(gathered(p, "text", n_positive, "positives"), "q").join(gathered(p, "number", n_positive, "gold_numbers"), "q")
    return out.join(gathered(negatives, "text", n_negative, "negatives"), "q", "left")

"""Retrieval quality and tests of differences, from tables of ranks and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric, vec
from ..sources.scratch import kept
from .order import before, numbered


def gold_ranks(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, rank): one more than the documents that score strictly above the query's gold. scores: q, id, cos."""
    own = gold.join(scores, ["q", "id"]).groupBy("q").agg(F.max("cos").alias("g"))
    return scores.join(own, "q").groupBy("q").agg((F.sum(F.when(F.col("cos") > F.col("g"), 1).otherwise(0)) + 1).cast("bigint").alias("rank"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("n"), hit(1).alias("recall_1"), hit(10).alias("recall_10"), mrr.alias("mrr_10"), F.percentile("rank", 0.5).alias("median_rank"), F.avg("rank").alias("mean_rank"))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("cos").desc(), "id")))


def set_recall(ranks: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean share of a query's golds in the first k, and share of queries with all of them."""
    hits = gold.join(ranks.where(F.col("rank") <= k).select("q", "id", "rank"), ["q", "id"], "left")
    by = hits.groupBy("q").agg((F.count("rank") / F.count(F.lit(1))).alias("share"))
    return by.agg(F.avg("share").alias("set_recall"), F.avg(F.when(F.col("share") == 1, 1.0).otherwise(0.0)).alias("all_gold"))


def ndcg(ranks: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(q, ndcg, recall_100): linear gains, log2 discount; queries without relevant documents are left out."""
    gain = lambda r: F.col("rel") / F.log2(r + F.lit(1.0))
    good = qrels.where("rel > 0")
    got = good.join(ranks.select("q", "id", "rank"), ["q", "id"], "left")
    real = got.groupBy("q").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.avg(F.when(F.col("rank") <= 100, 1.0).otherwise(0.0)).alias("recall_100"))
    best = good.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("rel").desc(), "id"))).where(F.col("r") <= k)
    ideal = best.groupBy("q").agg(F.sum(gain(F.col("r"))).alias("ideal"))
    return real.join(ideal, "q").select("q", (F.col("dcg") / F.col("ideal")).alias("ndcg"), "recall_100")


def least_golds(searches: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, id): for each search (id, label) the least other id of its label: two ids of each label are enough to tell."""
    two = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("_first"))
    rest = rows.join(two, "label").where("id <> _first").groupBy("label").agg(F.min("id").alias("_second"))
    known = searches.select(F.col("id").alias("q"), "label").join(two, "label").join(rest, "label", "left")
    return known.select("q", F.when(F.col("q") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("id")).where("id IS NOT NULL")


def ranks_of(searches: DataFrame, golds: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, rank): one more than the rows, but the search itself, that lie strictly above the search's gold; counted in blocks.

    searches, rows: (id, vec) at unit length; golds: (q, id). Cosines within 1e-12 are equal.
    """
    from .pairs import counts_above

    gold = golds.join(rows.select("id", F.col("vec").alias("_g")), "id").select(F.col("q").alias("id"), "_g")
    asked = searches.join(gold, "id").select("id", "vec", (vec.dot(F.col("vec"), F.col("_g")) + 1e-12).alias("above"))
    return counts_above(asked, rows).select(F.col("id").alias("q"), (F.col("n") + 1).alias("rank"))


def label_hits(searches: DataFrame, rows: DataFrame, near: DataFrame) -> DataFrame:
    """(q, rank, rel): ranked neighbours near (src, dst, rank) of searches, and whether they have the search's label."""
    own = searches.select(F.col("id").alias("src"), F.col("label").alias("_ql"))
    known = near.join(rows.select(F.col("id").alias("dst"), "label"), "dst").join(own, "src")
    return known.select(F.col("src").alias("q"), F.col("dst").alias("id"), "rank", "cos", (F.col("label") == F.col("_ql")).alias("rel"))


def label_golds(searches: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, n): how many other rows have a search's label; none are left out."""
    sizes = rows.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    return searches.select(F.col("id").alias("q"), "label").join(sizes, "label").where("n > 0").select("q", "n")


def set_recall_of(hits: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """set_recall() from hits (q, rank, rel) and the golds' numbers (q, n)."""
    got = hits.where((F.col("rank") <= k) & F.col("rel")).groupBy("q").agg(F.count(F.lit(1)).alias("h"))
    share = golds.join(got, "q", "left").select((F.coalesce("h", F.lit(0)) / F.col("n")).alias("share"))
    return share.agg(F.avg("share").alias("set_recall"), F.avg(F.when(F.col("share") == 1, 1.0).otherwise(0.0)).alias("all_gold"))


def ndcg_of(hits: DataFrame, golds: DataFrame, k: int = 10) -> DataFrame:
    """(q, ndcg, recall_100) of equal gains, from hits (q, rank, rel) of 100 places or more and the golds' numbers (q, n)."""
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    got = hits.where("rel").groupBy("q").agg(F.sum(gain).alias("dcg"), F.sum(F.when(F.col("rank") <= 100, 1).otherwise(0)).alias("h"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return golds.join(got, "q", "left").select("q", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall_100"))


def midranks(rows: DataFrame, value: str) -> DataFrame:
    """rows with midrank, from 1: equal values have the mean of their ranks. Distinct values are ordered, not rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = before(counts, [value], "_n", "_b").select(F.col(value).alias("_v"), (F.col("_b") + (F.col("_n") + 1) / 2).alias("midrank"))
    return rows.join(ranked, F.col(value) == F.col("_v")).drop("_v")


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (auc): chance that a positive row scores above another, ties half. Equal scores are one row first."""
    counts = rows.groupBy(score).agg(F.sum(F.when(F.col(positive), 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(positive), 0.0).otherwise(1.0)).alias("n"))
    won = before(counts, [score], "n", "b").withColumn("w", F.col("p") * (F.col("b") + F.col("n") / 2))
    return won.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    a = midranks(rows, x).withColumnRenamed("midrank", "_rx")
    return midranks(a, y).agg(F.corr("_rx", "midrank").alias("rho"))


def permutation_p(pairs: list[tuple[float, float]]) -> tuple[float, float]:
    """(rho, p): Spearman's rho of a few pairs (9 at most), and the share of all orders with as large an absolute value."""
    from itertools import permutations

    if len(pairs) > 9:
        raise ValueError("the exact test takes 9 pairs at most")
    rank = lambda v: np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])
    a, b = (rank([float(p[i]) for p in pairs]) for i in (0, 1))
    rho = lambda y: float(np.corrcoef(a, y)[0, 1])
    own = rho(b)
    every = [abs(rho(b[list(o)])) >= abs(own) - 1e-12 for o in permutations(range(len(b)))]
    return own, sum(every) / len(every)


def rank_agreement(rows: DataFrame, x: str, y: str, id: str = "id") -> DataFrame:
    """One row (agreement): the share of pairs that both columns order alike. For small tables of results."""
    a = rows.select(F.col(id).alias("i"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = rows.select(F.col(id).alias("j"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    met = a.join(b, F.col("i") < F.col("j"))
    return met.agg(F.avg(F.when(F.signum(F.col("xa") - F.col("xb")) == F.signum(F.col("ya") - F.col("yb")), 1.0).otherwise(0.0)).alias("agreement"))


def cohort(rows: DataFrame, base: str, after: str, share: float, id: str = "id") -> DataFrame:
    """One row: medians before and after of the items with the greatest base values."""
    most = math.ceil(rows.count() * share)
    slim = rows.select(id, base, after)
    top = numbered(slim, [F.col(base).desc(), id], "_r").where(F.col("_r") < most)
    return top.agg(F.count(F.lit(1)).alias("n"), F.percentile(base, 0.5).alias("before"), F.percentile(after, 0.5).alias("after"))


def switched(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many hits were gained and lost."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return rows.agg(one(~F.col(before) & F.col(after)).alias("fixed"), one(F.col(before) & ~F.col(after)).alias("broken"))


def mcnemar(rows: DataFrame, before: str, after: str) -> dict:
    r = switched(rows, before, after).first()
    return {"fixed": r["fixed"], "broken": r["broken"], "p": numeric.binomial_tail(r["fixed"] or 0, (r["fixed"] or 0) + (r["broken"] or 0))}


def bootstrap(rows: DataFrame, value: str, id: str = "q", reps: int = 10_000, seed: int = 0, cluster: str | None = None) -> DataFrame:
    """(mean, lo, hi): a column's mean with its 95 % interval over draws with replacement; clusters are drawn whole.

    A draw picks the number that the MD5 of its replicate and place gives, so any engine draws the same.
    The work is replicates times clusters, in parallel.
    """
    key = cluster or id
    one = rows.groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    own = kept(numbered(one, [key], "_k").select(F.col("_k").alias("k"), F.col("_s").alias("s"), F.col("_c").alias("c")))
    n = max(1, own.count())
    spark = rows.sparkSession
    draws = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "i")), 1, 12), 16, 10).cast("bigint") % n
    means = draws.select("rep", pick.alias("k")).join(F.broadcast(own) if n <= 200_000 else own, "k").groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    mean = own.agg((F.sum("s") / F.sum("c")).alias("mean"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).join(F.broadcast(mean)).select("mean", "lo", "hi")


def pair_scores(found: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, f1) of found pairs (a, b, cos) against gold pairs (a, b)."""
    marked = found.join(gold.withColumn("_g", F.lit(1)), ["a", "b"], "left")
    return _scored(marked, gold.agg(F.count(F.lit(1)).alias("g")), thresholds)


def label_pair_scores(found: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """pair_scores() where the gold pairs are those of one label, counted from the label sizes. labels: id, label."""
    a = labels.select(F.col("id").alias("a"), F.col("label").alias("_la"))
    b = labels.select(F.col("id").alias("b"), F.col("label").alias("_lb"))
    marked = found.join(a, "a").join(b, "b").withColumn("_g", F.when(F.col("_la") == F.col("_lb"), 1))
    n = labels.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _scored(marked, n.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("g")), thresholds)


def _scored(marked: DataFrame, golds: DataFrame, thresholds: list[float]) -> DataFrame:
    """Scores of found pairs whose _g isn't null where they are gold; golds: one row (g), the number of all."""
    at = marked.select("_g", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("cos"))).alias("threshold"))
    hit = at.groupBy("threshold").agg(F.count("_g").alias("tp"), F.count(F.lit(1)).alias("n"))
    out = hit.join(F.broadcast(golds))
    p, r = F.col("tp") / F.col("n"), F.col("tp") / F.col("g")
    return out.select("threshold", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def power(nulls: DataFrame, planted: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(statistic, threshold, power): the share of planted values above the nulls' quantile. Both: statistic, value."""
    cut = nulls.groupBy("statistic").agg(F.percentile("value", 1 - alpha).alias("threshold"))
    return planted.join(cut, "statistic").groupBy("statistic", "threshold").agg(F.avg(F.when(F.col("value") > F.col("threshold"), 1.0).otherwise(0.0)).alias("power"))

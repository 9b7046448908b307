"""Neighbour graphs as tables of edges (src, dst, cos, rank), and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import quantiles
from .pairs import top_k


def graph(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest by cosine of every unit row."""
    return top_k(rows, rows, k)


def euclidean_graph(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest by distance between the vectors as given; cos is still the cosine."""
    from ..functions import vec

    near = top_k(rows, rows, k, euclidean=True).drop("cos")
    u = rows.select("id", vec.unit(F.col("vec")).alias("u"))
    both = near.join(u.toDF("src", "p"), "src").join(u.toDF("dst", "q"), "dst")
    return both.select("src", "dst", vec.dot(F.col("p"), F.col("q")).alias("cos"), "rank")


def mutual(edges: DataFrame) -> DataFrame:
    """The edges whose reverse is there too, ranked anew."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("cos").desc(), "dst"))
    return edges.join(back, ["src", "dst"], "left_semi").withColumn("rank", rank)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, dist): each edge once, with its least distance 1 - cos, and 1e-6 at least."""
    d = F.greatest(1 - F.col("cos"), F.lit(1e-6))
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(d).alias("dist"))


def occurrences(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, hits): how often each node is a neighbour; none is 0."""
    hits = edges.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return nodes.select("id").join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))


def hub_skew(hits: DataFrame) -> DataFrame:
    """One row: the population skewness of the occurrences; 0 where they are all equal."""
    return hits.agg(F.when(F.stddev_pop("hits") > 0, F.skewness("hits")).otherwise(0.0).alias("hub_skew"))


def margins(edges: DataFrame) -> DataFrame:
    """(id, margin): the first neighbour's cosine less the second's."""
    two = edges.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("rank") == 1, F.col("cos"))).alias("c1"), F.max(F.when(F.col("rank") == 2, F.col("cos"))).alias("c2"))
    return two.where("c2 IS NOT NULL").select("id", (F.col("c1") - F.col("c2")).alias("margin"))


def sparsity(edges: DataFrame) -> DataFrame:
    """(id, dist, isolated): distance to the first neighbour; isolated: at the 90th percentile or beyond."""
    first = edges.where("rank = 1").select(F.col("src").alias("id"), (1 - F.col("cos")).alias("dist"))
    return first.select("id", "dist", (F.col("dist") >= F.lit(quantiles(first, "dist", [0.9])[0])).alias("isolated"))


def purity(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, label, purity): the share of a node's neighbours with its label; nodes without any have none."""
    a = rows.select(F.col("id").alias("src"), "label")
    b = rows.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    same = F.when(F.col("label") == F.col("other"), 1.0).otherwise(0.0)
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.avg(same).alias("purity"))


def distance_to_measure(edges: DataFrame) -> DataFrame:
    """(id, dtm): root mean square chord to the neighbours."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.avg(F.greatest(2 - 2 * F.col("cos"), F.lit(0.0)))).alias("dtm"))


def mean_similarity(edges: DataFrame, k: int) -> DataFrame:
    """(id, density): mean cosine to the first k."""
    return edges.where(F.col("rank") <= k).groupBy(F.col("src").alias("id")).agg(F.avg("cos").alias("density"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(id, share): of the first k neighbours in graph a, those that graph b has among its own."""
    return overlaps(a, b, [k]).select("id", F.col(f"k{k}").alias("share"))


def overlaps(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """(id, k<k> ...): overlap() for several numbers of neighbours, by one join."""
    x = a.where(F.col("rank") <= max(ks)).select("src", "dst", "rank")
    y = b.where(F.col("rank") <= max(ks)).select("src", "dst", F.col("rank").alias("_r"))
    share = lambda k: (F.sum(F.when(F.greatest("rank", "_r") <= k, 1).otherwise(0)) / F.lit(float(k))).alias(f"k{k}")
    met = x.join(y, ["src", "dst"], "left").withColumn("_r", F.coalesce("_r", F.lit(max(ks) + 1)))
    return met.groupBy(F.col("src").alias("id")).agg(*map(share, ks))


def mutual_density(edges: DataFrame, k: int) -> DataFrame:
    """(id, density): mean cosine to those of the first k that have the node among their own first k; without any, the least density of all."""
    near = edges.where(F.col("rank") <= k)
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_m"))
    own = near.join(back, ["src", "dst"], "left").groupBy(F.col("src").alias("id")).agg(F.avg(F.when(F.col("_m") == 1, F.col("cos"))).alias("density"))
    return own.join(F.broadcast(own.agg(F.coalesce(F.min("density"), F.lit(0.0)).alias("_least")))).select("id", F.coalesce("density", "_least").alias("density"))


def densities(edges: DataFrame, ks: list[int], mutual: bool = False) -> DataFrame:
    """(id, k<k> ...): mean_similarity(), or mutual_density(), for several numbers of neighbours, by one pass or one join."""
    near = edges.where(F.col("rank") <= max(ks)).select("src", "dst", "cos", "rank")
    if mutual:
        back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("_r"))
        near = near.join(back, ["src", "dst"], "left").withColumn("rank", F.greatest("rank", F.coalesce("_r", F.lit(max(ks) + 1))))
    return near.groupBy(F.col("src").alias("id")).agg(*(F.avg(F.when(F.col("rank") <= k, F.col("cos"))).alias(f"k{k}") for k in ks))


def greedy_groups(edges: DataFrame, nodes: DataFrame, size: int = 2, most: int = 200_000) -> DataFrame:
    """(group, place, id): disjoint groups of an anchor and its `size` nearest unused neighbours, anchors by mixed id.

    Which group a node is in depends on all earlier ones, so the graph (bounded: more than `most` nodes
    is an error) is walked on the driver.
    """
    from .sampling import mixed

    order = [r["id"] for r in nodes.select("id", mixed(F.col("id")).alias("h")).orderBy("h", "id").limit(most + 1).collect()]
    if len(order) > most:
        raise ValueError(f"more than {most} nodes: sample them first")
    near: dict = {}
    for r in edges.orderBy("src", "rank").collect():
        near.setdefault(r["src"], []).append(r["dst"])
    used: set = set()
    out = []
    for anchor in order:
        if anchor in used:
            continue
        own = [x for x in near.get(anchor, []) if x not in used][:size]
        if len(own) < size:
            continue
        used.update([anchor, *own])
        number = len(out) // (size + 1)
        out += [(number, place, x) for place, x in enumerate([anchor, *own])]
    kind = nodes.schema["id"].dataType.simpleString()
    return nodes.sparkSession.createDataFrame(out, f"group int, place int, id {kind}")

"""Links among nodes that share a cell of some grid, without all pairs of a hot cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sized
from .components import components

#: Cells of more nodes than this are joined by classes; the other ones pair by pair.
HOT = 1024
#: One node in so many is counted to tell which cells are hot.
PROBED = 16
AT = ["t", "c"]

#: Of the sketches of two nodes, as lists of columns.
Near = Callable[[list[Column], list[Column]], Column]
Verify = Callable[[DataFrame], DataFrame]


def _columns(names: tuple[str, ...], suffix: str = "") -> list[Column]:
    return [F.col(f"{c}{suffix}") for c in names]


def least_links(keys: DataFrame, sketch: tuple[str, ...], near: Near, verify: Verify) -> DataFrame:
    """(a, b): links of every node to the least one of its cells. keys: (t, c, node, sketch ...)."""
    least = keys.groupBy(*AT).agg(F.min_by(F.struct("node", *(c for c in sketch if c != "node")), "node").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = least.select(*AT, F.col("m.node").alias("a"), *(F.col(f"m.{c}").alias(f"{c}_") for c in sketch))
    met = keys.join(least, AT).where((F.col("node") != F.col("a")) & near(_columns(sketch), _columns(sketch, "_")))
    return verify(met.select("a", F.col("node").alias("b")).distinct())


def with_classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (node, ...) with `class`, the least node that links reach."""
    roots = sized(materialize(components(links)))
    return rows.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")


def linked(keys: DataFrame, sketch: tuple[str, ...], near: Near, verify: Verify = lambda pairs: pairs, known: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: links that connect what all links would connect; no component is lost.

    keys: (t, c, node, class, sketch ...), the cell of each grid that a node lies in; near() compares sketches; class
    names what `known` links connect already. A pair that shares a cell, is near and passes verify() is a
    link; pairs of one class are left out. Cells of up to `hot` nodes give all their other pairs. In
    a larger cell every node is first compared with the least one; these links make larger
    classes. Then only nodes outside the cell's largest class meet the whole cell, and only other
    classes. So a cell full of copies costs its nodes, not their pairs. Which cells are hot is told
    by a hash sample of the nodes; it chooses the way, never the result.
    """
    few = keys.where(F.pmod(F.xxhash64(F.lit("probe"), "node"), F.lit(PROBED)) == 0).groupBy(*AT).agg(F.count(F.lit(1)).alias("n"))
    big = materialize(few.where(F.col("n") >= max(2, hot // PROBED)).select(*AT))
    any_big = not big.isEmpty()
    cold = keys.join(sized(big), AT, "left_anti") if any_big else keys
    own = ("node", "class", *(c for c in sketch if c != "node"))
    side = lambda n: cold.select(*AT, *(F.col(c).alias(f"{c}{n}") for c in own))
    pairs = side(1).join(side(2), AT).where((F.col("node1") < F.col("node2")) & (F.col("class1") != F.col("class2")) & near(_columns(sketch, "1"), _columns(sketch, "2")))
    links = verify(pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct())
    links = materialize(links if known is None else links.union(known))
    if not any_big:
        discard(big)
        return links
    rows = materialize(keys.join(sized(big), AT, "left_semi").drop("class"))
    more = materialize(links.union(least_links(rows, sketch, near, verify)))
    marked = materialize(with_classes(rows, more))
    largest = marked.groupBy(*AT, "class").agg(F.count(F.lit(1)).alias("n")).groupBy(*AT).agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    told = marked.join(largest.select(*AT, "main"), AT)
    others = told.where("class <> main").select(*AT, *(F.col(c).alias(f"{c}1") for c in own))
    whole = told.select(*AT, *(F.col(c).alias(f"{c}2") for c in own), (F.col("class") == F.col("main")).alias("in_main"))
    met = others.join(whole, AT).where((F.col("class1") != F.col("class2")) & (F.col("in_main") | (F.col("node1") < F.col("node2"))) & near(_columns(sketch, "1"), _columns(sketch, "2")))
    rest = verify(met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct())
    out = materialize(more.union(rest))
    for t in (links, more, rows, marked, big):
        discard(t)
    return out

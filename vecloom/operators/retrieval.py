"""Corpora, questions and their evaluation: pools, disjoint sets, routing of duplicates, ranks by variant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.embed import Client, embed
from . import evaluate, project
from .pairs import at_least
from .sampling import mixed, taken


def of_ids(rows: DataFrame, wanted: DataFrame, id: str = "id") -> DataFrame:
    """The rows whose id is wanted; wanted ids, if few, go to the scan."""
    ids = wanted.select(id).distinct()
    return rows.join(F.broadcast(ids) if ids.limit(100_001).count() <= 100_000 else ids, id, "left_semi")


def open_corpus(named: dict[str, DataFrame]) -> DataFrame:
    """(id, text, origin) of several corpora (id, text); ids are told apart by their origin's name."""
    out = None
    for name, rows in named.items():
        own = rows.select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("id"), "text", F.lit(name).alias("origin"))
        out = own if out is None else out.unionByName(own)
    return out


def stripped(label: Column, prefix: str) -> Column:
    """label without a prefix."""
    return F.when(label.startswith(prefix), F.substring(label, F.lit(len(prefix) + 1), F.length(label))).otherwise(label)


def candidate_pool(rows: DataFrame, by: str, each: int, wanted: DataFrame, id: str = "id") -> DataFrame:
    """(id, by, place): `each` rows of every group by mixed id, and all wanted ones, once each, in mixed order."""
    from .order import numbered

    drawn = taken(rows.select(id, by), [by], F.lit(each), id, 0, "_in").where("_in").drop("_in")
    pool = drawn.union(of_ids(rows.select(id, by), wanted, id)).distinct()
    return numbered(pool.withColumn("_h", mixed(F.col(id), 1)), ["_h", id], "place").drop("_h")


def aligned(manifest: DataFrame, vectors: DataFrame, id: str = "id") -> DataFrame:
    """manifest with the vectors' columns; an error if an id of the manifest has none."""
    out = manifest.join(vectors.withColumn("_there", F.lit(True)), id, "left")
    missing = out.where("_there IS NULL").count()
    if missing:
        raise ValueError(f"{missing} ids of the manifest have no vector")
    return out.drop("_there")


def truncated_references(texts: DataFrame, client: Client, characters: int, held: Column, dim: int) -> DataFrame:
    """texts (id, text) with `embedding`: that of their first characters; zeros for rows held out."""
    marked = texts.select("id", F.substring("text", 1, characters).alias("text"), held.alias("_held"))
    done = embed(marked.where("NOT _held").select("id", "text"), client)
    return done.union(marked.where("_held").select("id", "text", F.array_repeat(F.lit(0.0).cast("float"), dim).alias("embedding")))


def authored(questions: DataFrame, evaluation: DataFrame, texts: DataFrame) -> DataFrame:
    """Questions (q, question, golds) fit for training, one row a gold: (q, question, gold, text).

    Left out: those whose text an evaluation question (question, golds) has, repeats (the least q stays), those
    that share a gold with it, and those of which a gold has no text (id, text).
    """
    asked = questions.join(evaluation.select("question").distinct(), "question", "left_anti")
    held = evaluation.select(F.explode("golds").alias("gold")).distinct()
    long = asked.select("q", "question", F.explode("golds").alias("gold"))
    bad = long.join(held, "gold", "left_semi").select("q")
    known = long.join(texts.select(F.col("id").alias("gold"), "text"), "gold", "left")
    bare = known.where("text IS NULL").select("q")
    kept = known.join(bad.union(bare).distinct(), "q", "left_anti")
    first = kept.groupBy("question").agg(F.min("q").alias("q"))
    return kept.join(first, ["q", "question"], "left_semi").select("q", "question", "gold", "text")


def canonical(rows: DataFrame, cosine: float) -> DataFrame:
    """(id, root): the least id of each group of rows that cosines of at least `cosine` connect."""
    return project.graph_components(at_least(rows, cosine), rows)


def arm(name: str, before: DataFrame, after: DataFrame, dropped: Column | int, k: int = 10) -> DataFrame:
    """One row, none without searches: ranks (q, rank) of the same searches before and after a change."""
    both = before.select("q", F.col("rank").alias("b")).join(after.select("q", F.col("rank").alias("a")), "q")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    hit = lambda c: F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0))
    return both.select("b", "a").agg(
        F.lit(name).alias("arm"), F.lit(dropped).cast("bigint").alias("dropped"), F.percentile("b", 0.5).alias("median_before"), F.percentile("a", 0.5).alias("median_after"),
        hit("b").alias("hit_before"), hit("a").alias("hit_after"), one((F.col("b") > k) & (F.col("a") <= k)).alias("fixed"), one((F.col("b") <= k) & (F.col("a") > k)).alias("broken"), F.count(F.lit(1)).alias("n"),
    ).where("n > 0").drop("n")


def routed(searches: DataFrame, golds: DataFrame, corpus: DataFrame, distractors: DataFrame, cosine: float) -> DataFrame:
    """Two rows (arm ...): what dropping duplicates among distractors, and in the corpus itself with golds led to the row that stays, does to ranks."""
    far = canonical(distractors, cosine)
    own = canonical(corpus, cosine)
    lost = lambda c: c.where("id <> root").count()
    staying = lambda rows, c: rows.join(c.where("id = root").select("id"), "id", "left_semi")
    every = corpus.select("id", "vec").union(distractors.select("id", "vec"))
    fewer = corpus.select("id", "vec").union(staying(distractors, far).select("id", "vec"))
    one = arm("distractors", evaluate.ranks_of(searches, golds, every), evaluate.ranks_of(searches, golds, fewer), lost(far))
    led = golds.join(own, "id").select("q", F.col("root").alias("id")).where("q <> id")
    two = arm("corpus", evaluate.ranks_of(searches, golds, corpus), evaluate.ranks_of(searches, led, staying(corpus, own)), lost(own))
    return one.union(two)


def by_variant(variants: dict[str, DataFrame], golds: DataFrame, corpora: dict[str, DataFrame], searches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(variant, corpus, q, rank): the gold's rank for every way to put a query and every corpus."""
    out = None
    for v, rows in variants.items():
        for c, corpus in corpora.items():
            ranks = evaluate.ranks_of(searches(rows), golds, corpus).select(F.lit(v).alias("variant"), F.lit(c).alias("corpus"), "q", "rank")
            out = ranks if out is None else out.union(ranks)
    return out

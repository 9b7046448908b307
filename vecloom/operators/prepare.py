"""Preparation of texts for retrieval sets: filters, matches by citation, joins that keep sets apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .sampling import capped

#: A question that names its source gives the answer away.
LEAK = r"§|\bC\.?F\.?R\b|\bU\.?S\.?C\b|(?i:\bpart\s+\d+|\bsection\s+\d+|\bversion\s+\d+)"


def leaks(text: Column, pattern: str = LEAK) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def cleaned(text: Column) -> Column:
    """Without leading numbers and quotes, white space made single."""
    t = F.regexp_replace(text, r"^[\s\"']*(?:\d+[.)]\s*)?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\"']+\s*$", ""), r"\s+", " "))


def items(rows: DataFrame, ids: list[str], titles: list[str], texts: list[str]) -> DataFrame:
    """(id, text): the first of each list that a row has; title and text joined by a newline."""
    first = lambda names: F.coalesce(*(F.col(c).cast("string") for c in names if c in rows.columns), F.lit(None).cast("string"))
    return rows.select(first(ids).alias("id"), F.concat_ws("\n", F.nullif(first(titles), F.lit("")), first(texts)).alias("text"))


def matched(questions: DataFrame, documents: DataFrame, on: list[str]) -> DataFrame:
    """Questions with the one document of the same key; keys of several documents match nothing."""
    rest = [c for c in documents.columns if c not in on]
    once = documents.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in rest)).where("_n = 1").drop("_n")
    return questions.join(once, on)


def without(rows: DataFrame, held: DataFrame, id: str, text: str) -> DataFrame:
    """Rows neither whose id nor whose exact text is among those held out."""
    kept = rows.join(held.select(id).distinct(), id, "left_anti")
    return kept.join(held.select(text).distinct(), text, "left_anti").select(*rows.columns)


def with_distractors(gold: DataFrame, corpus: DataFrame, by: str, left_out) -> DataFrame:
    """gold and the corpus but for one value of `by`, with `role`."""
    return gold.withColumn("role", F.lit("gold")).unionByName(corpus.where(F.col(by) != left_out).withColumn("role", F.lit("distractor")))


def siblings(rows: DataFrame, by: list[str], id: str, take: int = 2) -> DataFrame:
    """Up to `take` rows of each group of two or more. Tasks keep `take` rows a group before any shuffle."""
    first = capped(rows, by, [F.col(id)], take)
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").toDF(*(f"_by{i}" for i in range(len(by))), "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return first.join(many, same, "left_semi")


def dense_ids(rows: DataFrame, key: str, out: str = "number") -> DataFrame:
    """Whole numbers from 0 for the distinct keys, in their order."""
    keys = rows.select(key).distinct()
    return rows.join(numbered(keys, [key], out), key)


def canonical(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, canonical): of rows with equal normalized text the one of least id."""
    norm = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t\n\r]+", " ")), 256)
    keyed = rows.select(id, norm.alias("_k"))
    return keyed.join(keyed.groupBy("_k").agg(F.min(id).alias("canonical")), "_k").select(id, "canonical")


def judgements(lines: DataFrame) -> DataFrame:
    """(q, id, rel) of qrels lines with four columns (query 0 document grade) or three."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.length(F.trim("value")) > 0).select(p.alias("p")).where(F.size("p").isin(3, 4))
    four = F.size("p") == 4
    out = rows.select(F.col("p")[0].alias("q"), F.when(four, F.col("p")[2]).otherwise(F.col("p")[1]).alias("id"), F.element_at("p", -1).alias("r"))
    return out.where(F.col("r").rlike(r"^-?\d+$")).select("q", "id", F.col("r").cast("int").alias("rel"))

"""The shape that operators take vectors in: (id, vec array<double>, label), checked and at unit length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from ..sources.scratch import kept
from .order import numbered

VECTORS = ("embedding", "embeddings", "vector", "vectors", "emb", "x")
IDS = ("id", "ids", "vec_id", "doc_id", "key", "uuid")
LABELS = ("label", "labels", "group", "cluster", "subset", "class")


@dataclass(frozen=True)
class Columns:
    vector: str | None
    id: str | None
    label: str | None
    wide: tuple[str, ...] = ()


def resolve(schema: T.StructType, vector: str | None = None, id: str | None = None, label: str | None = None) -> Columns:
    """Name the columns: as given, else by the usual names; without an array of numbers every numeric column is a dimension."""
    names = {f.name.lower(): f.name for f in schema}

    def pick(given: str | None, usual: tuple[str, ...]) -> str | None:
        if given is not None:
            if given not in schema.names:
                raise ValueError(f"there is no column {given}")
            return given
        return next((names[u] for u in usual if u in names), None)

    id_, label_ = pick(id, IDS), pick(label, LABELS)
    arrays = [f.name for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    v = pick(vector, VECTORS)
    if v is None or v not in arrays:
        v = arrays[0] if arrays and vector is None else v if vector else None
    wide = () if v else tuple(f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in (id_, label_))
    if not v and not wide:
        raise ValueError("there is no column of vectors and no numeric column")
    return Columns(v, id_, label_, wide)


def vectors(df: DataFrame, columns: Columns | None = None) -> DataFrame:
    """(id, vec, label) as given, in doubles. Rows without an id column get one by order of content."""
    c = columns or resolve(df.schema)
    v = vec.doubles(F.col(c.vector)) if c.vector else F.array(*(F.col(x).cast("double") for x in c.wide))
    label = F.col(c.label) if c.label else F.lit(None).cast("string")
    if c.id:
        return df.select(F.col(c.id).alias("id"), v.alias("vec"), label.alias("label"))
    rows = df.select(v.alias("vec"), label.alias("label"))
    marked = rows.withColumns({"_h": F.xxhash64("vec", "label"), "_m": F.monotonically_increasing_id()})
    return numbered(kept(marked), ["_h", "_m"], "id").select("id", "vec", "label")


def validate(rows: DataFrame) -> DataFrame:
    """One row: n, dim, and how many rows are null, of another length, not finite, zero, or repeat an id."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    dims = rows.agg(F.max(F.size("vec")).alias("dim"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), one(v.isNull()).alias("n_null"), F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("dim"), one(bad).alias("n_not_finite"), one(F.forall(v, lambda x: x == 0)).alias("n_zero"))
    ids = rows.groupBy("id").count().agg(one(F.col("count") > 1).alias("n_repeated_ids"))
    uneven = rows.join(F.broadcast(dims)).agg(one(F.size("vec") != F.col("dim")).alias("n_uneven"))
    return out.drop("least").join(F.broadcast(ids)).join(F.broadcast(uneven))


def checked(rows: DataFrame) -> DataFrame:
    """rows, or an error that says what is wrong with them. All rows are read."""
    r = validate(rows).first()
    wrong = {k: r[k] for k in ("n_null", "n_not_finite", "n_uneven") if r[k]}
    if not r["n"] or wrong:
        raise ValueError(f"no usable vectors: {wrong or 'there are no rows'}")
    return rows


def unit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", vec.unit(F.col("vec")))

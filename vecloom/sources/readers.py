"""Readers of vectors and texts: parquet, json lines, csv, npy, npz and text."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema

#: Kinds by priority where a folder holds several.
KINDS = (".parquet", ".pq", ".npz", ".npy", ".jsonl", ".csv")


def shards(source: str) -> list[str]:
    """The files of a path, a folder (of its first kind by priority) or a pattern, sorted."""
    p = Path(source)
    if p.is_dir():
        for kind in KINDS:
            if found := sorted(map(str, p.glob(f"*{kind}"))):
                return found
        raise ValueError(f"{source} holds no file of vectors")
    found = [str(p)] if p.exists() else sorted(map(str, p.parent.glob(p.name)))
    if not found:
        raise ValueError(f"there is no file {source}")
    return found


def _arrays(spark: SparkSession, paths: list[str], rows: int = 20_000) -> DataFrame:
    """(row, vec) of npy files; tasks read ranges of rows from memory maps."""
    parts, start = [], 0
    for p in paths:
        n, d = np.load(p, mmap_mode="r").shape
        parts += [(p, a, min(n, a + rows), start + a) for a in range(0, n, rows)]
        start += n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, a, z, at in b.itertuples(index=False):
                x = np.asarray(np.load(p, mmap_mode="r")[a:z], np.float64)
                yield pd.DataFrame({"row": np.arange(at, at + z - a), "vec": list(x)})

    table = spark.createDataFrame(parts, "path string, a bigint, z bigint, at bigint")
    return table.repartition(min(len(parts), 1024)).mapInPandas(run, "row bigint, vec array<double>")


def read_vectors(spark: SparkSession, source: str | np.ndarray | DataFrame, vector: str | None = None, id: str | None = None, label: str | None = None, ids: list | str | None = None, labels: list | str | None = None) -> DataFrame:
    """(id, vec, label) of any source. ids, labels: beside the rows, as lists, npy or text files, of equal length."""
    if isinstance(source, DataFrame):
        df = schema.vectors(source, schema.resolve(source.schema, vector, id, label))
        numbered = None
    elif isinstance(source, np.ndarray):
        numbered = _numbered(spark, source)
    else:
        paths = shards(source)
        kind = Path(paths[0]).suffix
        if kind == ".npy":
            numbered = _arrays(spark, paths)
        elif kind == ".npz":
            numbered, own = _archive(spark, paths, vector, id, label)
            ids, labels = ids if ids is not None else own[0], labels if labels is not None else own[1]
        else:
            numbered = None
            parquet = lambda p: spark.read.parquet(*p)
            form = {".parquet": parquet, ".pq": parquet, ".jsonl": spark.read.json, ".csv": lambda p: spark.read.csv(p, header=True, inferSchema=True)}
            got = form[kind](paths)
            df = schema.vectors(got, schema.resolve(got.schema, vector, id, label))
    if numbered is None:
        return df
    out = numbered
    for values, name in ((ids, "id"), (labels, "label")):
        if values is not None:
            out = out.join(_sidecar(spark, values, name, numbered.count()), "row")
    if ids is None:
        out = out.withColumn("id", F.col("row"))
    if labels is None:
        out = out.withColumn("label", F.lit(None).cast("string"))
    return out.select("id", "vec", "label")


def _archive(spark, paths, vector, id, label):
    xs, names, groups = [], [], []
    for p in paths:
        with np.load(p, allow_pickle=False) as z:
            flat = {k: z[k] for k in z.files}
        two = {k: v for k, v in flat.items() if v.ndim == 2}
        key = next((k for k in [vector, *schema.VECTORS] if k in two), None) or max(two, key=lambda k: two[k].size)
        xs.append(two[key])
        names.append(flat.get(id or next((k for k in schema.IDS if k in flat), "")))
        groups.append(flat.get(label or next((k for k in schema.LABELS if k in flat), "")))
    x = np.concatenate(xs).astype(np.float64)
    join = lambda y: None if any(v is None for v in y) else np.concatenate(y).tolist()
    return _numbered(spark, x), (join(names), join(groups))


def _numbered(spark, x):
    return spark.createDataFrame(list(enumerate(np.asarray(x, np.float64).tolist())), "row bigint, vec array<double>")


def _sidecar(spark, values, name, n):
    if isinstance(values, str):
        values = np.load(values).tolist() if values.endswith(".npy") else Path(values).read_text().splitlines()
    values = list(values)
    if len(values) != n:
        raise ValueError(f"{len(values)} values of {name} for {n} rows")
    return spark.createDataFrame(pd.DataFrame({"row": np.arange(n), name: values}))


def read_texts(spark: SparkSession, source: str, text: str = "text", id: str | None = None, label: str | None = None) -> DataFrame:
    """(id, text, label) of json lines, csv, parquet or plain text lines; without ids the rows get one by content, unique over all files."""
    at = Path(source) if not Path(source).is_dir() else next(p for p in sorted(Path(source).iterdir()) if p.name[0] not in "._")
    kind = Path(at.stem).suffix if at.suffix == ".gz" else at.suffix
    form = {".jsonl": spark.read.json, ".json": spark.read.json, ".csv": lambda p: spark.read.csv(p, header=True, multiLine=True, escape='"'), ".parquet": spark.read.parquet, ".txt": lambda p: spark.read.text(p).withColumnRenamed("value", text)}
    df = form[kind](source)
    own = F.col(id).cast("string") if id else F.concat_ws("-", F.sha2(F.col(text), 256), F.monotonically_increasing_id().cast("string"))
    return df.select(own.alias("id"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"))


def row_count(df: DataFrame) -> int:
    """From the files' own counts: no column is read."""
    return df.count()

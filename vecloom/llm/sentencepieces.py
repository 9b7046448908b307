"""Operator 8: SentencePiece encoding and decoding with chunks of giant documents in parallel.

A document of up to `giant` characters is one chunk and never leaves its task. A giant one is cut
into chunks of `chunk` characters, each with a margin of the longest piece, and spread over tasks.
Each gives its boundary-state transfer matrix; a document's matrices (a few hundred bytes a
chunk) are scanned in the max-plus semiring, which fixes the state at every boundary; then each
chunk is traced back alone. See pieces.py.

Defined results: null and empty texts have no ids. Ids are those of the sentencepiece library;
decoding gives the text back, but U+2581 comes back as a space. Repeated rows and null ids keep
a row each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, small_batches, turn_to, worker_tables
from .pieces import Model, edges
from .tokens import tokenizer_path

MODEL, GIANT, CHUNK = "piece_bpe_32k.model", 1 << 16, 1 << 14


def model_of(path: str) -> Model:
    """One for each Python process: a reused worker keeps its memos until it turns to another operator."""
    turn_to("pieces")
    kept = worker_tables("pieces")
    if path not in kept:
        kept[path] = Model.load(path)
    return kept[path]


def _chunks(docs: DataFrame, key: str, text: str, path: str, giant: int, chunk: int) -> DataFrame:
    """(key, doc, k, window, a, b, n): the chunks of giant documents; doc names the row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, count = model_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, x in enumerate(batch.column(1).to_pylist()):
                s, count = model.normal(x), count + 1
                starts = range(0, len(s), chunk)
                for j in range(0, len(starts), 256):
                    rows = []
                    for a in starts[j : j + 256]:
                        lo, b = max(0, a - model.longest), min(len(s), a + chunk)
                        rows.append((a // chunk, s[lo : b + model.longest], a - lo, b - lo))
                    k, window, a, b = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i] * n)), pa.array([(part << 40) + count] * n), *(pa.array(v) for v in (k, window, a, b)), pa.array([len(starts)] * n)],
                        names=[key, "doc", "k", "window", "a", "b", "n"],
                    )

    return docs.select(key, text).where(F.length(text) > giant).mapInArrow(run, f"`{key}` {kind}, doc bigint, k bigint, window string, a bigint, b bigint, n bigint")


def _states(chunks: DataFrame, path: str) -> DataFrame:
    """(doc, k, entry, leave): the numbers of the boundary states of every chunk."""

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            m = [model.transfer(w, x, y) for w, x, y in zip(*(b.column(c).to_pylist() for c in ("window", "a", "b")), strict=True)]
            flat = [pa.array([x.shape[1] for x in m], pa.int64()), pa.array([x.ravel().tolist() for x in m], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("k"), *flat], names=["doc", "k", "width", "matrix"])

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        at = edges([np.array(m).reshape(-1, w) for m, w in zip(rows["matrix"], rows["width"], strict=True)])
        return pd.DataFrame({"doc": rows["doc"], "k": rows["k"], "entry": at[:-1], "leave": at[1:]})

    spread = chunks.repartition(F.xxhash64("doc", "k")).select("doc", "k", "window", "a", "b")
    made = spread.mapInArrow(transfer, "doc bigint, k bigint, width bigint, matrix array<double>")
    return made.groupBy("doc").applyInPandas(combine, "doc bigint, k bigint, entry bigint, leave bigint")  # a string's length bounds the group


def _whole(docs: DataFrame, path: str, key: str, text: str, giant: int) -> DataFrame:
    """(key, ids binary) of documents of one chunk."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.encode_many([x or "" for x in b.column(1).to_pylist()]), pa.binary())], names=[key, "ids"])

    return docs.select(key, text).where(F.coalesce(F.length(text), F.lit(0)) <= giant).mapInArrow(run, f"`{key}` {kind}, ids binary")


def _giant(docs: DataFrame, path: str, key: str, text: str, giant: int, chunk: int) -> DataFrame:
    """(key, doc, k, ids binary): the ids of every chunk of giant documents."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "doc", "k", "ids"]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            ids = []
            for w, a, b, i, o in zip(*(batch.column(c).to_pylist() for c in ("window", "a", "b", "entry", "leave")), strict=True):
                ids.append(model.back(w, a, b, model.edge_states(w, a)[i], model.edge_states(w, b)[o]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("doc"), batch.column("k"), pa.array(ids, pa.binary())], names=names)

    chunks = materialize(_chunks(docs, key, text, path, giant, chunk))
    states = materialize(_states(chunks, path))
    known = chunks.join(states, ["doc", "k"]).select(key, "doc", "k", "window", "a", "b", "entry", "leave")
    return known.mapInArrow(back, f"`{key}` {kind}, doc bigint, k bigint, ids binary")


def encode_chunks(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(key, doc, k, ids binary): little-endian unsigned 32-bit ids of each chunk of each document, k from 0.

    doc is null for documents of one chunk; giant ones' chunks have a number in common.
    """
    path = path or tokenizer_path(MODEL)
    small_batches(docs.sparkSession)
    one = _whole(docs, path, key, text, giant).select(key, F.lit(None).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("k"), "ids")
    return one.union(_giant(docs, path, key, text, giant, chunk))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(key, ids array<bigint>) of every document."""
    path = path or tokenizer_path(MODEL)
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        return rows.iloc[:1].assign(ids=b"".join(rows["ids"]))[[key, "ids"]]

    many = _giant(docs, path, key, text, giant, chunk).groupBy("doc").applyInPandas(join, f"`{key}` {kind}, ids binary")  # a string's length bounds the group
    packed = _whole(docs, path, key, text, giant).union(many)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[key, "ids"])

    return packed.mapInArrow(unpack, f"`{key}` {kind}, ids array<bigint>")


def decode(coded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of arrays of ids; a null array is a null text."""
    path = path or tokenizer_path(MODEL)
    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            texts = [None if x is None else model.plain(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return coded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def digest(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(key, n_ids, ids_crc32, decoded_bytes, decoded_crc32, exact) of every document's ids and what they decode to.

    exact: the decoded text is the document's (null: empty), by its bytes; of giant ones by SHA-256.
    """
    path = path or tokenizer_path(MODEL)
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    fields = "n_ids bigint, ids_crc32 bigint, decoded_bytes bigint, decoded_crc32 bigint"
    own = docs.select(key, F.col(text).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            rows = []
            for ids, t in zip(model.encode_many(texts), texts, strict=True):
                chars = model.plain(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids), len(chars), zlib.crc32(chars), chars == t.encode()))
            n, crc, size, plain_crc, exact = zip(*rows, strict=True) if rows else [()] * 5
            longs = [pa.array(v, pa.int64()) for v in (n, crc, size, plain_crc)]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(exact, pa.bool_())], names=[key, "n_ids", "ids_crc32", "decoded_bytes", "decoded_crc32", "exact"])

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        """Of a document's chunks in turn; the first chunk's first space is the model's own."""
        model, sha = model_of(path), hashlib.sha256()
        n, crc, size, plain_crc = 0, 0, 0, 0
        for i, ids in enumerate(rows.sort_values("k")["ids"]):
            n, crc = n + len(ids) // 4, zlib.crc32(ids, crc)
            chars = model.plain(np.frombuffer(ids, "<u4").tolist(), strip=not i)
            size, plain_crc = size + len(chars), zlib.crc32(chars, plain_crc)
            sha.update(chars)
        return pd.DataFrame({key: rows[key].iloc[:1], "n_ids": [n], "ids_crc32": [crc], "decoded_bytes": [size], "decoded_crc32": [plain_crc], "sha": [sha.hexdigest()]})

    small = own.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(whole, f"`{key}` {kind}, {fields}, exact boolean")
    large = _giant(own.where(F.length("text") > giant), path, key, "text", giant, chunk)
    told = large.groupBy("doc").applyInPandas(chained, f"`{key}` {kind}, {fields}, sha string")
    want = own.where(F.length("text") > giant).select(F.col(key).alias("_key"), F.sha2("text", 256).alias("_sha")).distinct()
    checked = told.join(want, F.col(key).eqNullSafe(F.col("_key")) & (F.col("sha") == F.col("_sha")), "left").withColumn("exact", F.col("_sha").isNotNull()).drop("_key", "_sha", "sha")
    return small.union(checked)


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))

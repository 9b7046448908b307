"""Operator 5: language ID by prediction by partial matching.

Each language has a context tree of bytes up to ORDER deep, frozen after training. A byte costs
its code length in the deepest context seen: a seen byte c / (n + d), else the escape d / (n + d)
and the next shorter context, down to one of 256. A whole text's code length is summed in every
language; the shortest wins. Text is lower-cased first; both sides start in a context of newlines.

Training is bounded: of the labelled rows, the `sample_docs` of each language with the least
hashes of their ids and texts (equal rows count once), at most `sample_bytes` bytes of each, and
at most `max_languages` labels: more are an error, as no set of languages has as many. Nothing
else is sampled.

Defined results: a null text, or one without any letter, is `und` with score 0. Ties go to the
first language in order. Without labelled rows every text is `und`. Null doc_ids and repeated
rows keep a row each; null labels never train.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, read, small_batches, turn_to

ORDER, SAMPLE_DOCS, SAMPLE_BYTES, MAX_LANGUAGES = 4, 300, 1 << 16, 256
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_START = b"\n" * ORDER


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Every `width` successive bytes as one number."""
    n = len(data) - width + 1
    out = data[:n].astype(np.uint64)
    for i in range(1, width):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    return out


class Trees:
    """Frozen context trees: for each order the n-grams' counts and the contexts' totals."""

    def __init__(self, names: list[str], texts: list[list[bytes]]):
        self.names = names
        self.orders = [[self._count(own, k) for k in range(ORDER, -1, -1)] for own in texts]

    @staticmethod
    def _count(texts: list[bytes], k: int) -> tuple[np.ndarray, ...]:
        every = [grams(np.frombuffer(_START + x, np.uint8)[ORDER - k :], k + 1) for x in texts if x]
        seen, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        context, at = np.unique(seen >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, n, len(context))
        distinct = np.bincount(at, minlength=len(context))
        return seen, np.log2(n), context, np.log2(total + distinct), np.log2(np.maximum(distinct, 1))

    def bits(self, g: np.ndarray) -> np.ndarray:
        """(len(g), languages): what the last byte of each full-width gram costs."""
        out = np.zeros((len(g), len(self.names)), np.float32)
        for j, orders in enumerate(self.orders):
            open_, cost = np.arange(len(g)), np.zeros(len(g))
            for k, (seen, count, context, total, distinct) in zip(range(ORDER, -1, -1), orders, strict=True):
                if not len(seen) or not len(open_):
                    continue
                own = g[open_] & np.uint64((1 << (8 * k + 8)) - 1)
                at = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
                known = context[at] == own >> np.uint64(8)
                here = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
                hit = seen[here] == own
                cost[open_] += np.where(known, total[at] - np.where(hit, count[here], distinct[at]), 0)
                open_ = open_[~hit]
            cost[open_] += 8
            out[:, j] = cost
        return out


class Scorer:
    """Code lengths of texts, with the costs of grams met before in a table of fixed size."""

    SLOTS, BLOCK = 20, 1 << 19

    def __init__(self, trees: Trees):
        self.trees = trees
        self.keys = np.full(1 << self.SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.costs = np.zeros((1 << self.SLOTS, len(trees.names)), np.float32)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each text; an empty text has 0."""
        out = np.zeros((len(texts), len(self.trees.names)))
        joined = np.frombuffer(b"".join(_START + x for x in texts), np.uint8)
        ends = np.cumsum([len(x) + ORDER for x in texts])
        for lo in range(0, len(joined) - ORDER, self.BLOCK):
            hi = min(len(joined) - ORDER, lo + self.BLOCK)
            g = grams(joined[lo : hi + ORDER], ORDER + 1)
            slot = (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)
            costs = self.costs[slot]
            miss = np.flatnonzero(self.keys[slot] != g)
            if len(miss):
                new, back = np.unique(g[miss], return_inverse=True)
                made = self.trees.bits(new)
                costs[miss] = made[back]
                put = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)
                self.keys[put], self.costs[put] = new, made
                one = np.flatnonzero(self.keys[put] == new)  # of grams that share a slot the last one written stays
                self.costs[put[one]] = made[one]
            # gram p ends at byte p + ORDER; those that end in a text's start are no cost
            first = int(np.searchsorted(ends, lo + ORDER, side="right"))
            while first < len(texts):
                begin, end = ends[first] - len(texts[first]) - ORDER, ends[first] - ORDER
                if begin >= hi:
                    break
                a, z = max(begin, lo), min(end, hi)
                if z > a:
                    out[first] += costs[a - lo : z - lo].sum(axis=0, dtype=np.float64)
                first += 1
        return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, max_languages: int = MAX_LANGUAGES) -> Trees:
    """Fit on a bounded sample: the rows of least hash, by language."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("sample"), key, text).alias("h"), F.col(text).alias("text"))
    slim = known.select("lang", "h").distinct()
    least = slim.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_docs).select("lang", "h")
    clip = F.substring(F.col("text").cast("binary"), 1, sample_bytes)
    # repeated rows have one hash and are one before they leave their tasks
    picked = known.join(F.broadcast(least.limit(sample_docs * max_languages + 1)), ["lang", "h"]).groupBy("lang", "h").agg(F.min(clip).alias("text"))
    by: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", "h").collect():  # sample_docs texts a language, clipped
        by.setdefault(r["lang"], []).append(bytes(r["text"]).decode("utf-8", "ignore").lower().encode())
    if len(by) > max_languages:
        raise ValueError(f"{len(by)} labels are more than {max_languages} languages")
    names = sorted(by)
    return Trees(names, [by[n] for n in names])


def identify(docs: DataFrame, trees: Trees, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` (doc_id) with lang_pred and score: the language of each whole text and its posterior probability."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = keep or ["doc_id"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = spark.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to()
        known = shared.value
        scorer = Scorer(known)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            letters = np.array([bool(x) and _LETTER.search(x) is not None for x in texts], bool)
            names, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if known.names and letters.any():
                bits = scorer.lengths([x.lower().encode("utf-8", "ignore") for x, ok in zip(texts, letters, strict=True) if ok])
                rel = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                names[letters] = np.array(known.names, object)[bits.argmin(axis=1)]
                score[letters] = 1 / rel.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
        del scorer
        give_back()

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = train(docs.where(fold() != 2))
    return identify(docs, trees).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

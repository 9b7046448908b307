"""Operator 3: SimHash near-duplicates.

A text's fingerprint is the bitwise majority over the hashes of its word shingles. The join maps a
fingerprint to the bit counts of its two-bit segments; the Manhattan distance of two such vectors
never exceeds the Hamming distance. Grids over some of the segments bring pairs together,
what meets is tested by Manhattan distance over all segments, then verified exactly.

near_duplicates() links fingerprints at 4 or fewer differing bits. The 32 segments form `blocks`
blocks, and there is a grid for every choice of blocks but four: a pair within Manhattan distance
four differs in four blocks at most, so it lies in one cell of some grid. More fingerprints
get more blocks: smaller cells, more grids.

similar() links texts whose shingle sets have a Jaccard similarity of at least `similarity`. Their
fingerprints are of many words, majorities over the distinct shingles: at similarity 0.8
two bits differ with chance p = 0.15. The segments of its grids have one bit, whose count is the bit
itself: segments of two agree with chance (1 - p)^2 + p^2 / 2 and by accident with 3 / 8, those of
one with 1 - p and 1 / 2, so that one-bit segments find the same pairs with a number of grids that grows as n to
the power 0.23 and not 0.32. Disjoint groups of `width` bits are the grids, as many as find a pair at the
threshold itself with chance RECALL; closer pairs are missed far less. What meets is tested by the Manhattan
distance of two words of the fingerprints, then verified on the whole sets.

Defined results: a null text counts as empty; a text without words has fingerprint zero (and an
empty set) and links like any other. Equal fingerprints, or equal sets, are one node of the join, so copies
never multiply it. Null doc_ids keep a row, null ids sort last as a component's name. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import least_links, linked, with_classes
from .common import PLACE, discard, give_back, materialize, named, read, sized, small_batches, turn_to, unsigned_hex
from .components import components

WORDS, SEED, BITS = 4, 42, 4
SEGMENTS, BLOCKS = 32, range(BITS + 1, 13)
#: What a row of a grid costs, in pairs that meet: of one long, and with a sketch.
ROW_COST, WIDE_ROW_COST = 10, 30
#: Hashes that are counted at once: bounds memory on long texts.
BLOCK = 1 << 14
SET_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99
#: Words whose hashes a task keeps.
MEMO = 100_000
#: Bytes of text in each of the two parts of a block of pairs, and bytes that any text counts besides its own.
BLOCK_BYTES, TEXT_BYTES = 2 << 20, 4096
#: Doublings of the way to a family's least node; what is further off is another family.
HOPS = 3
#: Standard deviations beyond the expected distance that the two words' test allows.
SLACK = 4.0
#: Fine cells of similar(), and bits that each has at least.
FINE, FINE_BITS = 6, 26
#: Bits of a grid of similar(): a cell's number is an int.
WIDTHS = range(4, 32)
_LANES, _PLACES = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """(rows, 64): how many hashes of each row have each bit. hashes: (rows, n).

    Bit k of every byte is counted in that byte's lane, up to 255 hashes at once.
    """
    rows, n = hashes.shape
    out = np.zeros((rows, 64), np.int64)
    step = 255 * max(1, BLOCK // (255 * rows))
    for at in range(0, n, step):
        part = hashes[:, at : at + step]
        if short := -part.shape[1] % 255 if part.shape[1] > 255 else 0:
            part = np.concatenate([part, np.zeros((rows, short), np.uint64)], axis=1)
        lanes = ((part[None] >> _PLACES[:, None, None]) & _LANES).reshape(8, rows, -1, min(255, part.shape[1])).sum(axis=3, dtype=np.uint64)
        each = lanes.view(np.uint8).reshape(8, rows, -1, 8).sum(axis=2, dtype=np.int64)
        out += each.transpose(1, 2, 0).reshape(rows, 64)
    return out


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    """The bits that over half of n hashes have, as one unsigned long a row."""
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str | None, words: int = WORDS) -> int:
    """The fingerprint, unsigned, of a whole text."""
    tokens = words_of(text)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    digest, size = xxhash.xxh64_intdigest, min(words, len(tokens))
    spans = zip(starts[:n].tolist(), ends[size - 1 : size - 1 + n].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    return int(majority(bit_counts(h[None, :]), n)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp bigint): the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(x, words) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _long(bits: int) -> Column:
    return F.lit(_signed(bits)).cast("bigint")


def segment_counts(x: Column) -> Column:
    """The counts of the 32 two-bit segments, each in unary in its own place: 00, 01 or 11.

    So the Manhattan distance of two vectors is the number of bits that differ.
    """
    low = _long(0x5555555555555555)
    even, odd = x.bitwiseAND(low), F.shiftrightunsigned(x, 1).bitwiseAND(low)
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def manhattan(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _mask(segments: range) -> int:
    return sum(3 << 2 * i for i in segments)


def grids(blocks: int, bits: int = BITS) -> list[int]:
    """The masks of all choices of blocks but `bits` of them."""
    cut = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    own = [_mask(range(a, b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def blocks_for(n: int, bits: int = BITS) -> int:
    """The number of blocks with the least rows and meetings for n fingerprints."""

    def cost(blocks: int) -> float:
        own = grids(blocks, bits)
        return ROW_COST * len(own) + n / 2 * sum(0.375 ** (m.bit_count() / 2) for m in own)

    return min(range(bits + 1, BLOCKS.stop), key=cost)


def links(fps: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints (fp) at `bits` or fewer differing bits that connect all such pairs."""
    if bits > BITS:
        raise ValueError(f"the grids serve distances up to {BITS}")
    masks = grids(blocks_for(n))
    v = segment_counts(F.col("fp"))
    cells = F.transform(F.arrays_zip(F.array(*(F.lit(t) for t in range(len(masks)))).alias("t"), F.array(*map(_long, masks)).alias("m")), lambda g: F.struct(g["t"].alias("t"), F.col("v").bitwiseAND(g["m"]).alias("c")))
    keys = fps.select("fp", v.alias("v")).select("fp", F.explode(cells).alias("k")).select("k.t", "k.c", *(F.col("fp").alias(c) for c in ("node", "class")))
    near = lambda x, y: (manhattan(segment_counts(x[0]), segment_counts(y[0])) <= bits) & (F.bit_count(x[0].bitwiseXOR(y[0])) <= bits)
    return linked(keys, ("node",), near)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, words: int = WORDS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links, its own included."""
    rows = materialize(fingerprints(docs, key, text, words))
    nodes = materialize(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes, nodes.count(), bits))
    root = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialize(root.join(least, "root").select("fp", "component_id"))
    discard(nodes)
    # equal fingerprints may be a third of all rows: those rows are spread over salts
    hot = rows.groupBy("fp").count().where(F.col("count") >= 1000).select("fp", F.ceil(F.col("count") / 1000).cast("int").alias("salts"))
    salted = names.join(hot, "fp", "left").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    marked = rows.join(sized(hot, 10_000), "fp", "left")
    salt = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    return marked.select(key, "fp", salt).join(salted, ["fp", "salt"]).select(key, "fp", "component_id")


# texts of similar shingle sets


def differing(similarity: float) -> float:
    """The chance that a bit differs between two sets of that Jaccard similarity, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits in a grid, grids): what costs least for n sets and finds a pair at the threshold with chance `recall`."""
    same = 1 - differing(similarity)
    grids = lambda w: math.ceil(math.log(1 - recall) / math.log(1 - same**w))
    width = min(WIDTHS, key=lambda w: grids(w) * (WIDE_ROW_COST + n / 2 * 0.5**w))
    return width, grids(width)


def longs_for(width: int, n_grids: int) -> int:
    """The longs of a fingerprint that hold the grids' bits, two at least."""
    return max(2, -(-width * n_grids // 64))


def shingle_set(text: str | None, words: int = SET_WORDS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle. known: a memo of words."""
    tokens = words_of(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    for w in set(tokens).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(shingles: np.ndarray, longs: int) -> np.ndarray:
    """`longs` unsigned longs: the majorities over as many hashes of each shingle."""
    salts = mixed(np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out, n = np.zeros(longs, np.uint64), len(shingles)
    for at in range(0, longs if n else 0, 16):
        some = salts[at : at + 16]
        counts = sum(bit_counts(mixed(shingles[None, a : a + BLOCK] ^ some[:, None])) for a in range(0, n, BLOCK))
        out[at : at + 16] = majority(counts, n)
    return out


def cell_numbers(fingerprint: np.ndarray, width: int, n_grids: int) -> np.ndarray:
    """The cell in each grid: grid i has the bits from i * width of the longs one after the other."""
    bits = np.unpackbits(fingerprint.view(np.uint8), bitorder="little")[: width * n_grids]
    return bits.reshape(n_grids, width) @ (np.int32(1) << np.arange(width, dtype=np.int32))


def marked(docs: DataFrame, longs: int, width: int, n_grids: int, words: int = SET_WORDS, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep ..., set, s0, s1, cells): set names a text's set, s0 and s1 are longs of its fingerprint, cells its cell in each grid."""
    small_batches(docs.sparkSession)
    names = [*keep, "set", "s0", "s1", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to()
        known: dict[bytes, int] = {}
        for b in batches:
            node, s, cells = [], [], []
            for x in b.column(len(keep)).to_pylist():
                if len(known) > MEMO:
                    known.clear()
                own = shingle_set(x, words, known)
                f = long_fingerprint(own, longs)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                s.append(f[:2].view(np.int64).tolist())
                cells.append(cell_numbers(f, width, n_grids))
            made = [pa.array(node, pa.int64()), *(pa.array([x[i] for x in s], pa.int64()) for i in (0, 1)), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=names)
        known.clear()
        give_back()

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{fields}`set` bigint, s0 bigint, s1 bigint, cells array<int>")


def alike(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of each pair of places a, b have that Jaccard similarity."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    each = np.split(ids, np.cumsum(sizes)[:-1])
    both, own, last = np.zeros(len(a), np.int64), np.zeros(len(every), bool), -1
    for k in np.argsort(a, kind="stable").tolist():
        if a[k] != last:
            own[each[last]] = False
            last = a[k]
            own[each[last]] = True
        both[k] = np.count_nonzero(own[each[b[k]]])
    return both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9


def blocks_of(pairs: DataFrame, sizes: DataFrame, families: DataFrame) -> DataFrame:
    """(a, b, block): pairs whose ends have one family share a block as long as BLOCK_BYTES hold it.

    sizes: (node, bytes); families: (node, family), a node that isn't there is its own. A larger family is
    divided by hash, and its pairs are dealt to blocks of two parts: so a text goes to as many blocks
    as its family has parts, however many pairs it has. Small families share a block.
    """
    weight = F.coalesce("bytes", F.lit(0)) + TEXT_BYTES
    own = materialize(sizes.join(sized(families), "node", "left").select("node", F.coalesce("family", "node").alias("family"), weight.alias("w")))
    shared = max(1, -(-(own.agg(F.sum("w")).first()[0] or 0) // BLOCK_BYTES))
    large = materialize(own.groupBy("family").agg(F.ceil(F.sum("w") / BLOCK_BYTES).alias("parts")).where("parts > 1"))
    part = F.when(F.col("parts").isNull(), F.xxhash64(F.pmod(F.xxhash64("family"), F.lit(shared)))).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("node"), "parts")))
    home = materialize(own.join(sized(large), "family", "left").select("node", part.alias("home")))
    met = pairs.join(sized(home).toDF("a", "ha"), "a").join(sized(home).toDF("b", "hb"), "b")
    out = materialize(met.select("a", "b", F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("block")))
    for t in (own, large, home):
        discard(t)
    return out


def _jaccard(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b): the rows (a, b, block) whose texts have similar sets. texts: (node, text); a block makes each of its sets once."""

    def run(met: pa.Table, own: pa.Table) -> pa.Table:
        turn_to()
        known: dict[bytes, int] = {}
        at, sets = {}, []
        for node, x in zip(own.column("node").to_pylist(), own.column("text").to_pylist(), strict=True):
            if len(known) > MEMO:
                known.clear()
            at[node] = len(sets)
            sets.append(shingle_set(x, words, known))
        a, b = (np.fromiter(map(at.__getitem__, met.column(c).to_pylist()), np.int64, len(met)) for c in ("a", "b"))
        out = met.select(["a", "b"]).filter(pa.array(alike(sets, a, b, similarity)))
        known.clear()
        del sets
        give_back()
        return out

    ends = pairs.select(F.col("block").alias("of"), F.col("a").alias("node")).union(pairs.select("block", "b")).distinct()
    return pairs.groupBy("block").cogroup(ends.join(texts, "node").select("of", "node", "text").groupBy("of")).applyInArrow(run, "a bigint, b bigint")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = SET_WORDS) -> tuple[DataFrame, DataFrame]:
    """named() documents, and (_file, _at, key, node, component) of their rows: component names what links connect."""
    rows = named(docs)
    n = max(1, rows.count())
    width, n_grids = plan(n, similarity)
    marks = materialize(marked(rows, longs_for(width, n_grids), width, n_grids, words, text, (*PLACE, key)))
    first = F.min_by(F.struct(*PLACE, "s0", "s1", "cells"), F.struct(*PLACE))
    # a written table: a node keeps its number
    nodes = materialize(marks.groupBy("set").agg(first.alias("f")).select("set", "f.*").withColumn("node", F.monotonically_increasing_id()))
    slim = materialize(marks.select(*PLACE, key, "set"))
    discard(marks)
    p = differing(similarity)
    most = int(128 * p + SLACK * math.sqrt(128 * p * (1 - p)))
    near = lambda x, y: (sum(manhattan(segment_counts(a), segment_counts(b)) for a, b in zip(x, y, strict=True)) <= most) & (sum(F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)) <= most)
    sketch = ("s0", "s1")

    def check(pairs: DataFrame, families: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        wanted = materialize(nodes.select("node", *PLACE).join(sized(ends), "node", "left_semi"))
        texts = materialize(rows.select(*PLACE, F.col(text).alias("text")).join(sized(wanted), list(PLACE)).select("node", "text"))
        met = blocks_of(pairs, texts.select("node", F.octet_length("text").alias("bytes")), families)
        out = materialize(_jaccard(met, texts, similarity, words))
        for t in (ends, wanted, texts, met):
            discard(t)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        """Each node with its least partner first; then only the pairs that this didn't connect."""
        pairs = materialize(pairs)
        one = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        # near least partners are of one family: edited copies of one text, whose pairs grow as the square of their number
        families = one.select(F.col("b").alias("node"), F.col("a").alias("family"))
        for _ in range(HOPS):
            families = families.join(families.toDF("family", "next"), "family", "left").select("node", F.coalesce("next", "family").alias("family"))
        families = materialize(families)
        done = check(one, families)
        root = sized(materialize(components(done)))
        far = pairs.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        rest = materialize(far.join(one, ["a", "b"], "left_anti"))
        return done if rest.isEmpty() else done.union(check(rest, families))

    # copies with few edits share cells of many bits, where hardly anything else lies: they are classes before the grids meet
    group = -(-FINE_BITS // width)
    joint = [F.xxhash64(*(F.col("cells")[min(n_grids - 1, i * group + j)] for j in range(group))) for i in range(min(FINE, max(1, n_grids // group)))]
    fine = nodes.select("node", *sketch, F.posexplode(F.array(*joint)).alias("t", "c"))
    known = materialize(least_links(fine, sketch, near, verify))
    keys = with_classes(nodes, known).select("node", "class", *sketch, F.posexplode("cells").alias("t", "c"))
    roots = materialize(components(linked(keys, sketch, near, verify, known)))
    named_sets = nodes.select("set", "node").join(sized(roots), "node", "left").select("set", F.coalesce("root", "node").alias("component"))
    return rows, slim.join(named_sets, "set").select(*PLACE, key, "set", "component")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = SET_WORDS) -> DataFrame:
    """docs with one row of each component of similar(): that of the smallest key (null last), then of the first place."""
    rows, found = similar(docs, key, text, similarity, words)
    order = F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("k"), *PLACE)
    kept = materialize(found.groupBy("component").agg(F.min(order).alias("m")).select(*(F.col(f"m.{c}") for c in PLACE)))
    return rows.join(sized(kept, 500_000), list(PLACE), "left_semi").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")

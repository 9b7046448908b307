"""Operator 1: Merkle fingerprints of documents. DataFrame functions only.

A text is cut at "\\n\\n" into sections, a section at "\\n" into paragraphs, a paragraph into leaves:
sentences, and of long ones pieces of at most 128 characters. Every node is a SHA-256 over its
children's hashes, so two texts have equal roots just when they are equal, and a differing branch
shows where an edit lies.

Likeness compares trees: equal nodes, repeats counted, weigh what lies in them. A leaf weighs
its characters, an inner node one. Only equal texts, whose roots are equal, have likeness 1.

Defined results: a null text counts as the empty text, which has one section with one paragraph
without leaves. Repeated rows each give a row. A null doc_id sorts as the smallest; rows of
one doc_id follow each other by text, descending, or where one doc_id holds many rows by the text's
hash. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, read

SECTION, PARAGRAPH = "\n\n", "\n"
#: A leaf ends with its sentence; a long one after a vowel and a space, so that cuts fall alike after an insertion.
LEAF = r"(?s).{0,126}?\. |.{64,126}?[aeiou] |.{1,128}"
#: Bytes of input that one range of doc_id is to hold, and ranges at most (the split points reach the driver).
RANGE_BYTES, MAX_RANGES = 32 << 20, 1 << 14
_LEAST = -(1 << 63)


def leaves(text: Column) -> Column:
    """array of sections<array of paragraphs<array of leaves (h: hash, w: characters)>>."""
    leaf = lambda x: F.struct(F.sha2(x, 256).alias("h"), F.length(x).cast("bigint").alias("w"))
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), leaf)
    section = lambda s: F.transform(F.split(s, PARAGRAPH, -1), paragraph)
    return F.transform(F.split(text, SECTION, -1), section)


def _node(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, " "), 256)


def _key(hash: Column) -> Column:
    """60 bits of a hash."""
    return F.conv(F.substring(hash, 1, 15), 16, 10).cast("bigint")


def trees(rows: DataFrame, text: str, to: str = "") -> DataFrame:
    """rows with the tree of a text column: root{to}, sections{to} (the paragraphs' hashes by section) and nodes{to}.

    nodes: every node as (h, w), 60 bits of its hash and its weight.
    """
    leaf, section, root = f"_leaves{to}", f"_sections{to}", f"root{to}"
    t = rows.withColumn(leaf, leaves(F.coalesce(F.col(text), F.lit(""))))
    t = t.withColumn(f"sections{to}", F.transform(leaf, lambda s: F.transform(s, lambda p: _node(p["h"]))))
    t = t.withColumn(section, F.transform(f"sections{to}", _node)).withColumn(root, _node(F.col(section)))
    inner = lambda h: F.struct(_key(h).alias("h"), F.lit(1).cast("bigint").alias("w"))
    own = F.transform(F.flatten(F.flatten(F.col(leaf))), lambda x: F.struct(_key(x["h"]).alias("h"), x["w"].alias("w")))
    every = F.concat(own, F.transform(F.flatten(F.col(f"sections{to}")), inner), F.transform(section, inner), F.array(inner(F.col(root))))
    return t.withColumn(f"nodes{to}", every).drop(leaf, section)


def _weight(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("bigint"), lambda a, x: a + x["w"])


def shared(a: Column, b: Column) -> Column:
    """The weight of the nodes that both have, as often as both have them: one sort of both, then one pass."""
    tag = lambda nodes, t: F.transform(nodes, lambda x: F.struct(x["h"].alias("h"), F.lit(t).alias("t"), x["w"].alias("w")))
    start = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("left"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(s["h"].eqNullSafe(x["h"]), s["left"]).otherwise(0)
        met = (x["t"] == 1) & (left > 0)
        return F.struct(x["h"].alias("h"), F.when(x["t"] == 0, left + 1).when(met, left - 1).otherwise(0).alias("left"), (s["sum"] + F.when(met, x["w"]).otherwise(0)).alias("sum"))

    return F.aggregate(F.array_sort(F.concat(tag(a, 0), tag(b, 1))), start, step, lambda s: s["sum"])


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared weight of two arrays of nodes over the sum of their weights, 0 to 1."""
    return 2 * shared(a, b) / (_weight(a) + _weight(b)).cast("double")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with root (string), sections (the paragraphs' hashes by section) and nodes."""
    return trees(docs, text)


def locate_edits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, section, paragraph): the branches of fingerprint() tables that differ, from 0.

    Only rows whose roots differ are opened, then only sections that differ.
    """
    o = old.select(key, F.col("root").alias("_r"), F.col("sections").alias("_old"))
    n = new.select(key, "root", F.col("sections").alias("_new"))
    both = o.join(n, key).where(F.col("_r") != F.col("root"))
    at = both.select(key, F.posexplode(F.arrays_zip("_old", "_new")).alias("section", "_s")).where(~F.col("_s._old").eqNullSafe(F.col("_s._new")))
    empty = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.coalesce("_s._old", empty).alias("o"), F.coalesce("_s._new", empty).alias("n"))
    return at.select(key, "section", F.posexplode(pairs).alias("paragraph", "_p")).where(~F.col("_p.o").eqNullSafe(F.col("_p.n"))).drop("_p")


def _points(ids: DataFrame, wanted: int) -> Counter:
    """Split points of k (long) for about `wanted` ranges of equal rows; a k of many rows counts as often as it fills ranges."""
    at = [i / wanted for i in range(1, wanted)]
    return Counter(ids.agg(F.percentile_approx("k", at or [0.5], 20 * MAX_RANGES).alias("q")).first()["q"] or [])


def _longs(values: list[int]) -> Column:
    """An array that folds to one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(k: Column, points: list[int]) -> Column:
    """Number of split points at or below k, found in two steps of about a root each."""
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    firsts = points[step - 1 :: step]
    coarse = F.size(F.filter(_longs(firsts), lambda x: x <= k))
    fine = F.size(F.filter(F.slice(_longs(points), coarse * step + 1, F.lit(step)), lambda x: x <= k))
    return coarse * step + fine


def _ranges(spark: SparkSession, docs: DataFrame) -> int:
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    known = int(size.toString()) if hasattr(size, "toString") else int(size)
    return min(MAX_RANGES, max(8 * parts(spark), known // RANGE_BYTES if known < 1 << 60 else 0))


def chained(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, k, k2, text, b, at, guest): documents in ranges that follow each other in descending (k, k2, text).

    k is the doc_id (null: the least long). Of a k that fills several ranges the rows are
    divided by k2, the text's hash. Each range also has, as guest, the first row of the next one; the last
    range that of the first. Texts are read once more for the guests, and not shuffled here.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST))
    points = _points(docs.select(key.alias("k")), ranges or _ranges(spark, docs))
    hot = {k: n for k, n in points.items() if n > 1}
    cuts = sorted(points)
    k = F.col("k")
    fills = F.try_element_at(F.create_map(*(F.lit(x).cast("bigint") for pair in hot.items() for x in pair)), k) if hot else F.lit(None).cast("bigint")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("k"))
    base = base.withColumn("k2", F.when(fills.isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")))
    # descending: the rows above a hot k, then those of k by falling k2
    part = F.coalesce(fills - F.least(F.floor((F.col("k2") / 2.0**64 + 0.5) * fills), fills - 1), F.lit(0).cast("bigint"))
    base = base.withColumn("b", ((len(cuts) - _range_of(k, cuts)).cast("bigint") * MAX_RANGES * 2 + part).cast("bigint"))
    order = F.struct("k", "k2")
    firsts = [(r["b"], *r["m"]) for r in base.groupBy("b").agg(F.max(order).alias("m")).orderBy("b").collect()]  # as many rows as there are ranges
    goes = spark.createDataFrame([(k, k2, b, firsts[i - 1][0]) for i, (b, k, k2) in enumerate(firsts)], "k bigint, k2 bigint, b bigint, at bigint")
    tied = Window.partitionBy("at").orderBy(F.col("text").desc())
    guests = base.join(F.broadcast(goes), ["k", "k2", "b"]).withColumn("_n", F.row_number().over(tied)).where("_n = 1")
    columns = ["doc_id", "k", "k2", "text"]
    return base.select(*columns, "b", F.lit(False).alias("guest")).union(guests.select(*columns, F.col("at").alias("b"), F.lit(True).alias("guest")))


def edit_chain(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: fingerprint, the fingerprint of its edited text, and both likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many of the
    next document's, in descending doc_id; after the last comes the first. Texts are shuffled
    once, to sorted ranges of doc_id; trees are made after that.
    """
    rows = trees(chained(docs, ranges).repartition("b"), "text").drop("sections")
    order = Window.partitionBy("b").orderBy("guest", F.col("k").desc(), F.col("k2").desc(), F.col("text").desc())
    linked = rows.withColumn("next", F.lead(F.struct("text", "nodes")).over(order)).where(~F.col("guest"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half))
    cut = linked.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "root", "nodes", F.col("next.nodes").alias("next_nodes"), edited.alias("edited"))
    made = trees(cut.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "_edited")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", F.col("root").alias("fingerprint"), F.col("root_edited").alias("edited_fingerprint"),
        likeness(F.col("nodes"), F.col("nodes_edited")).alias("near_edited"), likeness(F.col("nodes"), F.col("next_nodes")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_chain(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT doc_id, text, next, substring(text, 1, length(text) - length(text) // 2) || substring(next, 1, length(text) // 2) AS edited FROM n),
u AS (SELECT doc_id, unnest([0, 1, 2]) AS side, unnest([text, edited, next]) AS txt FROM e),
s AS (SELECT doc_id, side, unnest(range(len(ss))) AS i, unnest(ss) AS x FROM (SELECT doc_id, side, string_split(txt, chr(10) || chr(10)) AS ss FROM u)),
q AS (SELECT doc_id, side, i, unnest(range(len(ps))) AS j, unnest(ps) AS x FROM (SELECT doc_id, side, i, string_split(x, chr(10)) AS ps FROM s)),
p AS (SELECT doc_id, side, i, j, regexp_extract_all(x, '(?s).{0,126}?\. |.{64,126}?[aeiou] |.{1,128}') AS ls FROM q),
ph AS (SELECT doc_id, side, i, j, ls, sha256(array_to_string(list_transform(ls, lambda l: sha256(l)), ' ')) AS h FROM p),
sh AS (SELECT doc_id, side, i, sha256(string_agg(h, ' ' ORDER BY j)) AS h FROM ph GROUP BY 1, 2, 3),
rh AS (SELECT doc_id, side, sha256(string_agg(h, ' ' ORDER BY i)) AS h FROM sh GROUP BY 1, 2),
a AS (SELECT doc_id, side, h, 1 AS w FROM ph UNION ALL SELECT doc_id, side, h, 1 FROM sh UNION ALL SELECT doc_id, side, h, 1 FROM rh
    UNION ALL SELECT doc_id, side, sha256(l), length(l) FROM (SELECT doc_id, side, unnest(ls) AS l FROM p)),
c AS (SELECT doc_id, side, h, w, count(*) AS n FROM a GROUP BY 1, 2, 3, 4),
w AS (SELECT doc_id, side, sum(n * w) AS w FROM c GROUP BY 1, 2),
m AS (SELECT x.doc_id, y.side, sum(least(x.n, y.n) * x.w) AS m FROM c x JOIN c y ON x.side = 0 AND y.side > 0 AND x.doc_id = y.doc_id AND x.h = y.h GROUP BY 1, 2),
l AS (SELECT x.doc_id, y.side, CAST(2 * coalesce(m, 0) AS DOUBLE) / CAST(x.w + y.w AS DOUBLE) AS l FROM w x JOIN w y ON x.side = 0 AND y.side > 0 AND x.doc_id = y.doc_id LEFT JOIN m ON m.doc_id = x.doc_id AND m.side = y.side)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, f.h AS fingerprint, g.h AS edited_fingerprint, a.l AS near_edited, b.l AS near_next
FROM e JOIN rh f USING (doc_id) JOIN rh g USING (doc_id) JOIN l a USING (doc_id) JOIN l b USING (doc_id) WHERE f.side = 0 AND g.side = 1 AND a.side = 1 AND b.side = 2
"""

"""Operator 10: shards of near equal bytes by Karmarkar-Karp differencing.

Equal texts are one group, which is never divided. Groups are dealt to tasks by hash; each task
differences its groups down to one partial partition of n_shards sums, and the partial
partitions are differenced in turn (on the driver: one row of sums for each task, of a count
bounded by MAX_TASKS). Sizes are as near as indivisible groups allow: a group above a shard's fair
share has a shard that holds as much, and the others share the rest evenly.

Defined results: a null text weighs 1 (no bytes, plus 1) and its CRC is that of no bytes; it
groups with the empty text. Null and repeated doc_ids keep a row each. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, number, read

#: Groups that one task differences, and tasks at most (their sums reach the driver).
TASK_GROUPS, MAX_TASKS = 50_000, 20_000
#: Groups with at least this share of all rows are joined by broadcast: never more than 1024.
HOT_SHARE = 1 / 1024


def difference(weights: list[int], n: int) -> list[int]:
    """Karmarkar-Karp: the shard, 0 to n - 1, of each weight.

    The two partial partitions with the largest spread are combined, the one's largest part
    with the other's smallest, until one is left.
    """
    return [parts[0] for parts in difference_partial([(w,) for w in weights], n)[0]]


def difference_partial(partials: list[tuple[int, ...]], n: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions (sums of up to n parts each).

    Returns for each partial the shard of each of its parts, and the shards' sums. Parts are
    kept as a forest of pairings and resolved at the end, so a step costs n log n.
    """
    heap, pairs = [], []
    for i, sums in enumerate(partials):
        full = [*sums, *[0] * (n - len(sums))]
        order = sorted(range(n), key=lambda j: -full[j])
        full = [full[j] for j in order]
        pairs.append(("leaf", i, order))
        heap.append((full[-1] - full[0], len(pairs) - 1, full))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joined = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(n), key=lambda j: -joined[j])
        joined = [joined[j] for j in order]
        pairs.append((a, b, order))
        heapq.heappush(heap, (joined[-1] - joined[0], len(pairs) - 1, joined))
    shard: list[list[int]] = [[] for _ in partials]
    if not heap:
        return shard, [0] * n
    _, top, sums = heap[0]
    todo = [(top, list(range(n)))]
    while todo:
        node, label = todo.pop()  # label[r]: the shard of the node's r-th largest part
        a, b, order = pairs[node]
        at = [0] * n
        for r, j in enumerate(order):
            at[j] = label[r]
        if a == "leaf":
            shard[b] = at
        else:
            todo.append((a, at))
            todo.append((b, at[::-1]))
    return shard, sums


def shard(docs: DataFrame, n_shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row of docs in a shard, slots gapless from 0."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    same = F.unhex(F.sha2(t, 256))
    rows = materialize(docs.select(key, (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"), same.alias("same")))
    groups = materialize(rows.groupBy("same").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")))
    n_rows, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = min(MAX_TASKS, max(1, -(-n_groups // TASK_GROUPS)))
    dealt = groups.select("same", "w", "n", F.pmod(F.xxhash64("same"), F.lit(tasks)).cast("int").alias("task"))

    def partial(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["w", "same"], ascending=[False, True], kind="stable")
        where, _ = difference_partial([(int(w),) for w in part["w"]], n_shards)
        return part.assign(part=np.array([x[0] for x in where], np.int32))

    placed = materialize(dealt.groupBy("task").applyInPandas(partial, "same binary, w bigint, n bigint, task int, part int"))
    sums: dict[int, list[int]] = {}
    for r in placed.groupBy("task", "part").agg(F.sum("w").alias("w")).orderBy("task", "part").collect():  # tasks x n_shards rows
        sums.setdefault(r["task"], [0] * n_shards)[r["part"]] = r["w"]
    names = sorted(sums)
    where, _ = difference_partial([tuple(sums[t]) for t in names], n_shards)
    final = spark.createDataFrame([(t, p, where[i][p]) for i, t in enumerate(names) for p in range(n_shards)], "task int, part int, shard int")
    homes = placed.join(F.broadcast(final), ["task", "part"]).select("same", "n", "shard")
    # groups of a HOT_SHARE of the rows, 1024 at most, meet their rows by broadcast
    hot = F.col("n") >= max(2, int(n_rows * HOT_SHARE))
    few = F.broadcast(homes.where(hot).select("same", F.col("shard").alias("few")))
    left = rows.join(few, "same", "left")
    columns = [key, "size", "text_crc32", "shard"]
    one = left.where("few IS NOT NULL").withColumnRenamed("few", "shard").select(columns)
    two = left.where("few IS NULL").join(homes.where(~hot).select("same", "shard"), "same").select(columns)
    return number(materialize(one.union(two)), ["shard"], [key, "size", "text_crc32"], "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

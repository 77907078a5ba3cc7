"""Sharding by Karmarkar-Karp differencing.

Equal texts form one indivisible group. Blocks of groups are differenced in parallel: the two partial partitions with the
largest spread are combined, the fullest slots of one onto the emptiest of the other, until the block is one partial
partition of ``shards`` slots. The blocks' partial partitions are then differenced in the same way, a bounded number in
a task, level by level until one is left; the slot maps of the levels, followed down, give each group its shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import partitions, whole_text


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine the rows of ``partials`` (n, shards) into one partition; returns its sums and, per row, where each slot went.

    Rows are combined in order of spread, largest first, ties by position; the larger slots of one meet the smaller of the
    other. Sums are Python-exact while below 2^63.
    """
    n, shards = partials.shape
    sums = [None] * (2 * n - 1)
    heap = []
    for i in range(n):
        sums[i] = partials[i]
        heap.append((-int(partials[i].max() - partials[i].min()), i))
    heapq.heapify(heap)
    merges = []
    for new in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        up, down = np.argsort(sums[a], kind="stable"), np.argsort(sums[b], kind="stable")[::-1]
        sums[new] = sums[a][up] + sums[b][down]
        sums[a] = sums[b] = None
        merges.append((a, b, up, down))
        heapq.heappush(heap, (-int(sums[new].max() - sums[new].min()), new))
    place = np.empty((2 * n - 1, shards), np.int32)
    place[-1] = np.arange(shards)
    for new, (a, b, up, down) in zip(range(2 * n - 2, n - 1, -1), reversed(merges)):
        place[a, up] = place[new]
        place[b, down] = place[new]
    return sums[-1], place[:n]


def _first_level(shards: int):
    def run(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "group_key"], ascending=[False, True])
        partials = np.zeros((len(groups), shards), np.int64)
        partials[:, 0] = groups["bytes"]
        total, place = difference(partials)
        out = pd.DataFrame({"level": 0, "node": key[0], "parent": -1, "slot": place[:, 0], "group_key": groups["group_key"], "sums": None})
        return pd.concat([out, pd.DataFrame({"level": [1], "node": [key[0]], "parent": [-1], "slot": [-1], "group_key": [None], "sums": [total]})])

    return run


def _next_level(key: tuple, partials: pd.DataFrame) -> pd.DataFrame:
    partials = partials.sort_values("node")
    total, place = difference(np.stack(partials["sums"].to_numpy()).astype(np.int64))
    maps = pd.DataFrame({"node": partials["node"], "parent": key[0], "sums": None, "places": list(place)})
    return pd.concat([maps, pd.DataFrame({"node": [key[0]], "parent": [-1], "sums": [total], "places": [None]})])


def assign_shards(groups: DataFrame, shards: int, block_groups: int = 4096, fan_in: int = 512) -> DataFrame:
    """Shard of every (group_key binary, bytes long); keys are distinct. Adds ``shard`` int.

    ``block_groups`` and ``fan_in`` bound what one task holds at the first and at every later level.
    """
    groups = cut_lineage(groups.select("group_key", F.col("bytes").cast("long").alias("bytes")))
    nodes = max(1, -(-groups.count() // block_groups))
    first = cut_lineage(groups.withColumn("node", F.pmod(F.xxhash64("group_key"), F.lit(nodes))).groupBy("node").applyInPandas(
        _first_level(shards), "level int, node long, parent long, slot int, group_key binary, sums array<long>"))
    placed = first.filter("level = 0").select("group_key", "node", "slot")
    partials = first.filter("level = 1").select("node", "sums")
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = cut_lineage(partials.groupBy(F.pmod("node", F.lit(nodes)).alias("parent")).applyInPandas(
            _next_level, "node long, parent long, sums array<long>, places array<int>"))
        maps = level.filter("parent >= 0").select("node", "parent", "places")
        placed = (placed.join(maps, "node").select("group_key", F.col("parent").alias("node"), F.col("places")[F.col("slot")].alias("slot")))
        partials = level.filter("parent < 0").select("node", "sums")
    return placed.select("group_key", F.col("slot").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, spread: int | None = None, **bounds: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key.

    ``size`` is the UTF-8 length of the text (null: none) plus ``overhead``; ``law`` is "bytes": the sums of the shards are
    near equal, as far as groups of equal texts, which are never split, allow. ``slot`` counts the rows of a shard from 0
    without a gap, in an order that hashes give; null and repeated ids are rows like any other. A shard may be empty when
    there are fewer groups than shards. ``spread`` (by default the shuffle partitions) is into how many parts a group's
    rows are dealt while shards and slots reach them.
    """
    spread = spread or partitions(docs)
    text = whole_text()
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group_key"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(spread)).alias("part")))
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    # A hot group meets its shard once per part, and its rows meet it by (part, group).
    shard_of = cut_lineage(rows.select("part", "group_key").distinct().join(assign_shards(groups, shards, **bounds), "group_key"))
    placed = cut_lineage(rows.join(shard_of, ["part", "group_key"]))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group_key"))
    return (placed.withColumn("within", within).join(offsets, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key"))

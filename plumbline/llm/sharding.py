"""Shards of nearly equal sizes from indivisible groups, by best-fit-decreasing bin packing in two steps."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.plans.scale import checkpointed

SHARDS = 8
#: Lots that the sizes allow for each shard: the second step packs a number of lots that data cannot raise.
LOTS = 2048
#: Groups that one task packs into lots.
GROUPS = 50_000
#: Parts of a group by a hash of the document, so that the copies of one text are numbered by many tasks.
PARTS = 256


class Rooms:
    """The remaining capacities of bins in a balanced tree of two levels: sorted leaves that split when full."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.lowest: list[tuple[int, int]] = []

    def add(self, room: int, number: int) -> None:
        entry = (room, number)
        if not self.leaves:
            self.leaves, self.lowest = [[entry]], [entry]
            return
        at = max(0, bisect_left(self.lowest, entry) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        self.lowest[at] = leaf[0]
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.lowest[at : at + 1] = [leaf[0], leaf[half]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the tightest room for ``size``, the first bin among equals."""
        at = max(0, bisect_left(self.lowest, (size, -1)) - 1)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                entry = leaf.pop(i)
                if leaf:
                    self.lowest[at] = leaf[0]
                else:
                    del self.leaves[at], self.lowest[at]
                return entry
            at += 1
        return None


def best_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size, which come in falling order; a size beyond the capacity has a bin of its own."""
    rooms, bins, opened = Rooms(), [], 0
    for size in sizes:
        found = rooms.take(size)
        room, number = found if found else (capacity, opened)
        opened += found is None
        bins.append(number)
        if room > size:
            rooms.add(room - size, number)
    return bins


def fitted(sizes: Sequence[int], shards: int) -> list[int]:
    """Best fit into exactly ``shards`` bins of the smallest capacity that takes all: it is searched between
    the mean and the mean plus the largest size, where everything fits."""
    if not len(sizes):
        return []
    low = max(-(-sum(sizes) // shards), sizes[0])
    high = low + sizes[0]
    while low < high:
        middle = (low + high) // 2
        if max(best_fit(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return best_fit(sizes, low)


def shard(docs: DataFrame, shards: int = SHARDS, lots: int = LOTS, groups: int = GROUPS) -> DataFrame:
    """One row (doc_id, size, text_crc32, shard, slot) for each document: documents of equal texts are one
    indivisible group, a null text is an empty one, ``size`` is its bytes and one more.

    Every task packs its groups, the largest first, into lots of at most a ``lots``-th of a shard, a larger
    group being a lot; the lots, whose number is bounded by that, are packed in one task into ``shards`` bins
    of the least capacity. Slots are gapless from 0 in each shard: lots, groups and parts of groups have
    running offsets, and only within a part of a group (a hash of the document) are rows numbered. Repeated
    rows are each placed; rows without an id too. Empty tables give empty tables.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    octets = F.encode(text, "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"),
        F.unhex(F.md5(octets)).alias("digest"),
    )
    rows = checkpointed(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))))
    parts = checkpointed(rows.groupBy("digest", "size", "part").agg(F.count("*").alias("n")))
    group = parts.groupBy("digest", "size").agg(F.sum("n").alias("n"))
    group = checkpointed(group.withColumn("bytes", F.col("n") * F.col("size")))
    total, count = group.agg(F.sum("bytes"), F.count("*")).first()
    capacity = max(1, (total or 0) // (shards * lots))
    tasks = max(1, -(-count // groups))

    def lots_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "digest"], ascending=[False, True])
        frame["lot"] = best_fit(frame["bytes"].tolist(), capacity)
        return frame[["digest", "size", "n", "bytes", "task", "lot"]]

    dealt = group.withColumn("task", F.pmod(F.xxhash64("digest"), F.lit(tasks)))
    dealt = checkpointed(dealt.groupBy("task").applyInPandas(lots_of, "digest binary, size long, n long, bytes long, task long, lot long"))
    lot = dealt.groupBy("task", "lot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).withColumn("all", F.lit(0))

    def shards_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "task", "lot"], ascending=[False, True, True])
        frame["shard"] = fitted(frame["bytes"].tolist(), shards)
        frame["lot_at"] = frame.groupby("shard")["n"].transform(lambda n: n.cumsum() - n).astype(np.int64)
        return frame[["task", "lot", "shard", "lot_at"]]

    placed = checkpointed(lot.groupBy("all").applyInPandas(shards_of, "task long, lot long, shard int, lot_at long"))
    group_at = F.coalesce(F.sum("n").over(W.partitionBy("task", "lot").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = dealt.join(placed.hint("merge"), ["task", "lot"]).withColumn("group_at", F.col("lot_at") + group_at)
    part_at = F.coalesce(F.sum("n").over(W.partitionBy("digest", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("part_at", part_at).join(grouped.select("digest", "size", "shard", "group_at").hint("merge"), ["digest", "size"])
    offsets = offsets.select("digest", "size", "part", "shard", (F.col("group_at") + F.col("part_at")).alias("at"))
    number = F.row_number().over(W.partitionBy("digest", "size", "part").orderBy("doc_id")) - 1
    joined = rows.withColumn("number", number).join(offsets, ["digest", "size", "part"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("number")).alias("slot"))

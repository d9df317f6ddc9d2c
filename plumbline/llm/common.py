"""What several operators of this package share: connected components and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.scale import checkpointed, is_small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The connected components of an undirected graph: one row (node, root) for each node with an edge,
    ``root`` being the smallest node of its component.

    Every round points each node at the smallest neighbour of its neighbourhood and then each pointer's
    target at the smallest target (large star, small star), so rounds grow with the logarithm of the longest
    path. Minima are combined before the shuffle; rounds cut their lineage with a reliable checkpoint and merge
    their joins, as many broadcasts would fill the driver. Self links, repeated links and either direction are
    allowed; links with a null end are left out.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(big, small).distinct()
    links, before = checkpointed(links), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        target = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(target.hint("merge"), "u")
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(moved.union(target.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def look_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a written ``table`` with one row a key: broadcast where it is counted to be small, else
    shuffled, when Spark splits the partitions that a hot key makes too large."""
    return rows.join(F.broadcast(table) if is_small(table) else table, on, "left")

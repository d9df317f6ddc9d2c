"""Survivors of duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_as_null, quoted, ref
from plumbline.operators.check import total
from plumbline.operators.duplicates import one_of_each
from plumbline.operators.exact import exact_members

STRATEGIES = ("first", "last", "best")


def survivors(df: DataFrame, members: DataFrame, row_id: str, strategy: str = "first") -> DataFrame:
    """``(method, group_id, row_id)``: the row each group keeps: its first, its last, or the one with the
    fewest nulls (the first of those)."""
    groups = members.groupBy("method", "group_id")
    if strategy == "first":
        return groups.agg(F.min("row_id").alias("row_id"))
    if strategy == "last":
        return groups.agg(F.max("row_id").alias("row_id"))
    if strategy != "best":
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    rows = nan_as_null(df)
    nulls = F.expr(total([f"if({quoted(c)} IS NULL, 1, 0)" for c in df.columns if c != row_id]))
    graded = members.join(rows.select(ref(row_id).alias("row_id"), nulls.alias("nulls")), "row_id")
    return graded.groupBy("method", "group_id").agg(F.min_by("row_id", F.struct("nulls", "row_id")).alias("row_id"))


def merge_members(df: DataFrame, members: DataFrame, row_id: str, strategy: str = "first") -> DataFrame:
    """``df`` without the rows that some group drops. Groups drop independently: a row kept by one method's
    group may be dropped by another's. Both anti-joins are on row ids, so no group meets in one task."""
    kept = survivors(df, members, row_id, strategy)
    lost = members.join(kept, ["method", "group_id", "row_id"], "left_anti").select("row_id").distinct()
    return df.join(lost.withColumnRenamed("row_id", row_id), row_id, "left_anti").select(*[ref(c) for c in df.columns])


def merge_exact(df: DataFrame, row_id: str, strategy: str = "first", keys: list[str] | None = None) -> DataFrame:
    """``df`` with one row left of each exact group, on all columns but the id unless ``keys`` are given.

    On all columns the members of a group differ in their id only, so grouping alone yields the survivor;
    with ``best`` all are equally complete and the first stays. Rows without a twin do not move.
    """
    columns = [c for c in df.columns if c != row_id]
    if keys is not None and set(keys) != set(columns):
        return merge_members(df, exact_members(df, keys, row_id), row_id, strategy)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    whole = nan_as_null(df)
    complete = F.expr(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns))
    pick = F.max if strategy == "last" else F.min
    merged = one_of_each(whole.where(complete), columns, pick(ref(row_id)).alias(row_id))
    return merged.unionByName(whole.where(~complete)).select(*[ref(c) for c in df.columns])


def merge_summary(df: DataFrame, row_id: str, strategy: str = "first") -> DataFrame:
    """One row: ``(original_rows, merged_rows, removed_duplicates, strategy)`` of an exact merge."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counted = df.select(one.alias("before"), none.alias("after")).unionByName(
        merge_exact(df, row_id, strategy).select(none.alias("before"), one.alias("after"))
    )
    stats = counted.agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    before, after = (F.coalesce(F.col(c), none) for c in ("before", "after"))
    return stats.select(
        before.alias("original_rows"),
        after.alias("merged_rows"),
        (before - after).alias("removed_duplicates"),
        F.lit(strategy).alias("strategy"),
    )

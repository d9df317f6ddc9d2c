"""Groups of rows equal on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_as_null, ref
from plumbline.operators.duplicates import duplicate_sets, in_duplicate_sets


def _sets(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    return duplicate_sets(nan_as_null(df), keys, F.min(ref(row_id)).alias("__first"), nulls_equal=False)


def exact_groups(
    df: DataFrame, keys: list[str], row_id: str, show_keys: bool = False, sets: DataFrame | None = None
) -> DataFrame:
    """``(group_id, method, size, match_score, first_row)`` of each set of two or more rows equal on
    ``keys``, which follow if asked for. A row with a null key belongs to no group."""
    return (_sets(df, keys, row_id) if sets is None else sets).select(
        F.col("__first").cast("string").alias("group_id"),
        F.lit("exact").alias("method"),
        F.col("__n").alias("size"),
        F.lit(100.0).alias("match_score"),
        F.col("__first").alias("first_row"),
        *[ref(k) for k in keys if show_keys],
    )


def exact_members(df: DataFrame, keys: list[str], row_id: str, sets: DataFrame | None = None) -> DataFrame:
    """``(group_id, method, row_id)`` of every row in an exact group."""
    rows = nan_as_null(df).select(ref(row_id).alias("__row"), *[ref(k) for k in keys])
    return in_duplicate_sets(rows, keys, F.min("__row").alias("__first"), nulls_equal=False, sets=sets).select(
        F.col("__first").cast("string").alias("group_id"), F.lit("exact").alias("method"), F.col("__row").alias("row_id")
    )

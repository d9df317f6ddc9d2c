"""Duplicate groups by several methods side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape
from plumbline.operators.exact import exact_groups, exact_members
from plumbline.operators.fuzzy import THRESHOLD, fuzzy_groups, fuzzy_members
from plumbline.operators.phonetic import phonetic_groups, phonetic_members

METHODS = ("exact", "fuzzy", "phonetic")
GROUP_COLUMNS = ["group_id", "method", "size", "match_score"]


def _chosen(methods: Sequence[str], text_columns: Sequence[str]) -> list[str]:
    """Exact always works; the other methods need columns to compare."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    return [m for m in METHODS if m in methods and (m == "exact" or text_columns)]


def find_duplicates(
    df: DataFrame,
    row_id: str,
    key_columns: list[str] | None = None,
    text_columns: list[str] | None = None,
    methods: Sequence[str] = ("exact",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(group_id, method, size, match_score, matching_columns)`` of all groups found."""
    texts, keys = text_columns or [], key_columns or Shape.of(df, [row_id]).names
    found = {
        "exact": lambda: exact_groups(df, keys, row_id),
        "fuzzy": lambda: fuzzy_groups(df, texts, row_id, threshold),
        "phonetic": lambda: phonetic_groups(df, texts, row_id),
    }
    parts = [
        found[m]()
        .select(*GROUP_COLUMNS)
        .withColumn("matching_columns", F.array(*map(F.lit, keys if m == "exact" else texts)))
        for m in _chosen(methods, texts)
    ]
    return _union(df, parts, "group_id string, method string, size bigint, match_score double, matching_columns array<string>")


def duplicate_members(
    df: DataFrame,
    row_id: str,
    key_columns: list[str] | None = None,
    text_columns: list[str] | None = None,
    methods: Sequence[str] = ("exact",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(group_id, method, row_id)`` of all rows in those groups."""
    texts, keys = text_columns or [], key_columns or Shape.of(df, [row_id]).names
    found = {
        "exact": lambda: exact_members(df, keys, row_id),
        "fuzzy": lambda: fuzzy_members(df, texts, row_id, threshold),
        "phonetic": lambda: phonetic_members(df, texts, row_id),
    }
    id_type = df.schema[row_id].dataType.simpleString()
    parts = [found[m]() for m in _chosen(methods, texts)]
    return _union(df, parts, f"group_id string, method string, row_id {id_type}")


def _union(df: DataFrame, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def duplicate_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, rows in them (repeated across methods), groups by method, mean size, mean score."""
    return groups.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_duplicate_records"),
        *[F.count_if(F.col("method") == m).alias(f"{m}_groups") for m in METHODS],
        F.coalesce(F.bround(F.avg("size"), 2), F.lit(0.0)).alias("avg_group_size"),
        F.coalesce(F.bround(F.avg("match_score"), 2), F.lit(0.0)).alias("avg_match_score"),
    )

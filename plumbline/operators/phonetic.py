"""Groups of rows that sound alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_as_null, ref
from plumbline.functions.text import phonetic_key
from plumbline.operators.matching import PART, distinct_texts, group_similarity, text_columns
from plumbline.plans.scale import checkpointed, join_counted_keys


def phonetic_groups(df: DataFrame, columns: list[str], row_id: str, part: int = PART) -> DataFrame:
    """``(group_id, method, code, size, match_score)`` of two or more rows with the same code; rows with
    only empty values have none. The score is the mean similarity; no threshold applies."""
    texts = distinct_texts(df, columns, row_id)
    code = phonetic_key([F.col(t) for t in text_columns(len(columns))])
    texts = checkpointed(texts.withColumn("code", code).where(F.col("code").isNotNull()))
    scored = group_similarity(texts, "code", len(columns), part).where("size > 1")
    first = texts.groupBy("code").agg(F.min("first_row").cast("string").alias("group_id"))
    return scored.join(first, "code").select(
        "group_id", F.lit("phonetic").alias("method"), "code", "size", "match_score"
    )


def phonetic_members(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """``(group_id, method, row_id)`` of every row in a phonetic group."""
    df = nan_as_null(df)
    rows = df.select(ref(row_id).alias("row_id"), phonetic_key([ref(c) for c in columns]).alias("code"))
    rows = rows.where(F.col("code").isNotNull())
    groups = (
        rows.groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").cast("string").alias("group_id"))
        .where("n > 1")
    )
    return join_counted_keys(rows, groups, ["code"]).select(
        "group_id", F.lit("phonetic").alias("method"), "row_id"
    )

"""Uniqueness: repeated rows, and distinct values per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, mean2, ref, rounded, share
from plumbline.operators.check import metric, table_of
from plumbline.operators.duplicates import surplus_rows
from plumbline.operators.value_counts import distinct_counts, distinct_counts_by

DIMENSION = "uniqueness"
ROWS, BY_COLUMN = "Row Uniqueness", "Column Uniqueness"


def row_uniqueness(df: DataFrame, shape: Shape, sets: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that repeat an earlier row on all columns, nulls being equal; within each group of ``keys`` if given."""
    value = "if(rows > 0, bround((1 - extra / rows) * 100, 2), 100)"
    detail = {"duplicate_rows": "extra", "unique_rows": "rows - extra", "total_rows": "rows"}
    return table_of(
        surplus_rows(df, shape.names, True, sets, keys),
        [metric(DIMENSION, ROWS, value, "extra", "rows", detail=detail)],
        keys,
    )


def column_uniqueness(
    df: DataFrame, shape: Shape, approximate: bool = False, counted: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct share of the present values per column, per group of ``keys`` if given; the metric is the mean of
    the rounded shares."""
    rate = F.expr(rounded(share("distinct", "present", 0)))
    if keys:
        counted = distinct_counts_by(df, shape.names, keys)
    else:
        counted = distinct_counts(df, shape.names, approximate, counted)
    counted = counted.withColumn("value", rate)
    held = [ref(k) for k in keys]
    rows = F.collect_list(F.struct("column", "value", "distinct", "present"))  # one entry per column
    gathered = counted.groupBy(*held).agg(mean2(F.col("value")).alias("mean"), rows.alias("parts"))
    parts = F.transform(
        "parts",
        lambda p: F.struct(
            F.lit(DIMENSION).alias("dimension"),
            F.lit(BY_COLUMN).alias("name"),
            p["column"].alias("column"),
            p["value"].alias("value"),
            p["distinct"].alias("numerator"),
            p["present"].alias("denominator"),
            F.lit(None).cast("map<string,string>").alias("detail"),
        ),
    )
    head = F.expr(metric(DIMENSION, BY_COLUMN, "mean"))
    return gathered.select(*held, F.explode(F.concat(F.array(head), parts)).alias("m")).select(*held, "m.*")

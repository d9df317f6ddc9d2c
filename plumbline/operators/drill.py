"""The rows behind a metric: duplicates, missing values and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, nan_as_null, quoted
from plumbline.operators.accuracy import is_outlier
from plumbline.operators.duplicates import duplicate_rows
from plumbline.operators.quantiles import exact_quantiles

SHOWN_ROWS = 100


def rows_duplicated(df: DataFrame, column: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """All members of duplicate sets, over one column or over all but ``exclude``; nulls are equal."""
    df = nan_as_null(df)
    return duplicate_rows(df, [column] if column else Shape.of(df, exclude or []).names)


def rows_missing(df: DataFrame, column: str | None = None) -> DataFrame:
    """Rows with a null in ``column``, or in any column."""
    df = nan_as_null(df)
    return df.where(" OR ".join(f"{quoted(n)} IS NULL" for n in ([column] if column else df.columns)))


def rows_outlying(df: DataFrame, column: str | None) -> DataFrame:
    """Rows whose value lies outside the quartile fences; none unless ``column`` is numeric."""
    cleaned = nan_as_null(df)
    if column not in Shape.of(df).numerics:
        return cleaned.where(F.lit(False))
    quartiles = exact_quantiles(cleaned, [column], [0.25, 0.75])[column]
    outside = is_outlier(column, None if quartiles is None else (quartiles[0], quartiles[1]))
    # on the raw column first, where the scan can use it; a NaN may pass that but not the second test
    return nan_as_null(df.where(outside)).where(outside)


def explained(df: DataFrame, kind: str, column: str | None, order_by: list[str], limit: int = SHOWN_ROWS):
    """``(count, explanation, shown)`` for ``kind`` in duplicates, missing, outliers: the number of all
    offending rows, a sentence, and the first ``limit`` of them by ``order_by``; no rows for another kind."""
    if kind == "duplicates":
        rows, place = rows_duplicated(df, column, exclude=order_by), f" in column '{column}'" if column else ""
        text = "Found {} duplicate records" + place
    elif kind == "missing":
        rows, place = rows_missing(df, column), f" in '{column}'" if column else ""
        text = "Found {} records with missing values" + place
    elif kind != "outliers":
        return 0, f"Unknown kind of rows: {kind}", df.where(F.lit(False))
    elif column in Shape.of(df).numerics:
        rows, text = rows_outlying(df, column), f"Found {{}} outlier records in '{column}'"
    else:
        return 0, "No numeric column specified for outlier detection", df.where(F.lit(False))
    count = rows.count()
    return count, text.format(count), rows.orderBy(*order_by).limit(limit)

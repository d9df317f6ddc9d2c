"""Column profiles: one typed row per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, nan_as_null, number, quoted, rounded, share, string
from plumbline.operators.check import aggregated, table_of
from plumbline.operators.duplicates import surplus_rows
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.shared import Shared
from plumbline.operators.value_counts import Counted, distinct_counts


QUARTILES = [0.25, 0.5, 0.75]
#: Fields of a profile that only numbers or only texts have, with their types.
NUMBER_FIELDS = {f: "DOUBLE" for f in ("mean", "median", "std", "min", "max", "q25", "q75")}
LENGTH_FIELDS = {"min_length": "INT", "max_length": "INT", "avg_length": "DOUBLE"}


@dataclass(frozen=True)
class Part:
    """A part of the profile: aggregates, and per column the fields computed from them, all as SQL."""

    measures: dict[str, str]
    fields: dict[str, dict[str, str]]


def _nulls(shape: Shape) -> Part:
    measures = {"rows": "count(*)", **{f"p{i}": f"count({quoted(n)})" for i, n in enumerate(shape.names)}}
    fields = {
        f.name: {
            "ordinal": str(i),
            "dtype": string(f.dataType.simpleString()),
            "null_count": f"rows - p{i}",
            "null_percentage": rounded(share(f"rows - p{i}", "rows", 0)),
        }
        for i, f in enumerate(shape.fields)
    }
    return Part(measures, fields)


def _numbers(shape: Shape, quartiles: dict[str, list[float] | None]) -> Part:
    measures, fields = {}, {}
    for i, n in enumerate(shape.names):
        if n not in shape.numerics:
            continue
        for field, function in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            measures[f"{field}{i}"] = f"{function}(CAST({quoted(n)} AS DOUBLE))"
        q25, q50, q75 = map(number, quartiles[n] or (None, None, None))
        fields[n] = {
            "mean": f"mean{i}", "median": q50, "std": f"std{i}", "min": f"min{i}", "max": f"max{i}", "q25": q25, "q75": q75,
        }
    return Part(measures, fields)


def _lengths(shape: Shape) -> Part:
    measures, fields = {}, {}
    for i, n in enumerate(shape.names):
        if n not in shape.strings:
            continue
        for field, function in (("lo", "min"), ("hi", "max"), ("avg", "avg")):
            measures[f"{field}{i}"] = f"{function}(length({quoted(n)}))"
        fields[n] = {"min_length": f"lo{i}", "max_length": f"hi{i}", "avg_length": rounded(f"avg{i}")}
    return Part(measures, fields)


def _tabulate(df: DataFrame, columns: list[str], *parts: Part) -> DataFrame:
    """One row per column with the fields of all ``parts`` from one aggregation; a field is null for a
    column that does not have it."""
    measures = {name: sql for part in parts for name, sql in part.measures.items()}
    names = list(dict.fromkeys(field for part in parts for fields in part.fields.values() for field in fields))
    if len(parts) > 1:  # the whole profile has all fields, whatever the columns are
        names = list(dict.fromkeys([*names, *NUMBER_FIELDS, *LENGTH_FIELDS]))
    empty = {f: f"CAST(NULL AS {kind})" for f, kind in {**NUMBER_FIELDS, **LENGTH_FIELDS}.items()}
    rows = []
    for column in columns:
        known = {field: sql for part in parts for field, sql in part.fields.get(column, {}).items()}
        values = ", ".join(f"'{f}', {known.get(f) or empty[f]}" for f in names)
        rows.append(f"named_struct('column', {string(column)}, {values})")
    return table_of(aggregated(df, measures), rows)


def null_profile(df: DataFrame, shape: Shape | None = None) -> DataFrame:
    """``(column, ordinal, dtype, null_count, null_percentage)``."""
    df, shape = nan_as_null(df), shape or Shape.of(df)
    return _tabulate(df, shape.names, _nulls(shape))


def distinct_profile(
    df: DataFrame, shape: Shape | None = None, approximate: bool = False, counted: DataFrame | None = None
) -> DataFrame:
    """``(column, unique_count, unique_percentage)``."""
    df, shape = nan_as_null(df), shape or Shape.of(df)
    return distinct_counts(df, shape.names, approximate, counted).select(
        "column",
        F.col("distinct").alias("unique_count"),
        F.expr(rounded(share("distinct", "present", 0))).alias("unique_percentage"),
    )


def numeric_profile(df: DataFrame, shape: Shape | None = None) -> DataFrame:
    """Moments, range and quartiles of the numeric columns; null for a column without values."""
    df, shape = nan_as_null(df), shape or Shape.of(df)
    if not shape.numerics:
        fields = ", ".join(f"{f} {kind}" for f, kind in NUMBER_FIELDS.items())
        return df.sparkSession.createDataFrame([], f"column string, {fields}")
    return _tabulate(df, shape.numerics, _numbers(shape, exact_quantiles(df, shape.numerics, QUARTILES)))


def string_profile(df: DataFrame, shape: Shape | None = None) -> DataFrame:
    """``(column, min_length, max_length, avg_length)`` in characters, of text columns with values."""
    shape = shape or Shape.of(df)
    if not shape.strings:
        fields = ", ".join(f"{f} {kind}" for f, kind in LENGTH_FIELDS.items())
        return df.sparkSession.createDataFrame([], f"column string, {fields}")
    return _tabulate(df, shape.strings, _lengths(shape)).where(F.col("min_length").isNotNull())


def duplicate_profile(df: DataFrame, shape: Shape | None = None, sets: DataFrame | None = None) -> DataFrame:
    """One row: ``(total_records, duplicate_count, duplicate_percentage)``; rows with a null in any
    column count as no duplicate here, unlike in row uniqueness."""
    df, shape = nan_as_null(df), shape or Shape.of(df)
    return surplus_rows(df, shape.names, False, sets).select(
        F.col("rows").alias("total_records"),
        F.col("extra").alias("duplicate_count"),
        F.expr(rounded(share("extra", "rows", 0))).alias("duplicate_percentage"),
    )


def profile(df: DataFrame, exclude: list[str] | None = None, shared: Shared | None = None) -> DataFrame:
    """The whole profile, one row per column in table order: one aggregation for nulls, moments and lengths,
    one shuffle for distinct and top values; the joins are between tables of one row per column."""
    df = nan_as_null(df)
    shape = Shape.of(df, exclude or [])
    if shared:
        counted, ranked, quartiles = shared.distinct, shared.top, shared.quartiles
    else:
        counts = Counted.of(df, shape.names)
        counted, ranked = counts.distinct(), counts.top()
        quartiles = exact_quantiles(df, shape.numerics, QUARTILES)
    top = ranked.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("ranked")
    ).select(
        "column",
        F.when(F.col("column").isin(shape.strings), F.col("ranked")[0]["value"]).alias("mode"),
        F.transform("ranked", lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n"))).alias("top_values"),
    )
    basic = _tabulate(df, shape.names, _nulls(shape), _numbers(shape, quartiles), _lengths(shape))
    return (
        basic.join(distinct_profile(df, shape, counted=counted), "column", "left")
        .join(top, "column", "left")
        .orderBy("ordinal")
    )

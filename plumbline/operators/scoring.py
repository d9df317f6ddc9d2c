"""From metric rows to dimension scores, an overall score, and readings of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import mean2, round2

# The weight of each dimension in the overall score, and of any other one.
WEIGHTS = {
    "completeness": 0.25,
    "accuracy": 0.25,
    "consistency": 0.20,
    "uniqueness": 0.15,
    "validity": 0.15,
}
OTHER_WEIGHT = 0.1

# All dimensions; nothing measures timeliness, but a rule may name it.
DIMENSIONS = ("completeness", "accuracy", "consistency", "timeliness", "uniqueness", "validity")

# The lowest score of each band.
BANDS = ((90, "Excellent"), (70, "Good"), (50, "Fair"))
LOWEST_BAND = "Poor"
BY_COLUMN_METRICS = ("Column Completeness", "Column Uniqueness")


def dimension_scores(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, dimension, score)``: the mean of a dimension's metrics."""
    whole = metrics.where(F.col("column").isNull())
    return whole.groupBy(*keys, "dimension").agg(mean2(F.col("value")).alias("score"))


def weight_of(dimension: Column) -> Column:
    result = F.lit(OTHER_WEIGHT)
    for name, weight in WEIGHTS.items():
        result = F.when(dimension == name, F.lit(weight)).otherwise(result)
    return result


def overall_score(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, overall_score)``: the mean of the dimension scores by weight, over those present."""
    weight = weight_of(F.col("dimension"))
    value = F.sum(F.col("score") * weight) / F.sum(weight)
    return scores.groupBy(*keys).agg(F.coalesce(round2(value), F.lit(0.0)).alias("overall_score"))


def score_band(value: Column) -> Column:
    band: Column = F.lit(LOWEST_BAND)
    for least, name in reversed(BANDS):
        band = F.when(value >= least, F.lit(name)).otherwise(band)
    return band


def columns_of(metrics: DataFrame, name: str) -> DataFrame:
    """The per-column parts of one of the metrics that have them."""
    if name not in BY_COLUMN_METRICS:
        raise ValueError(f"{name} has no values by column")
    return metrics.where((F.col("name") == name) & F.col("column").isNotNull())


def worst_column(parts: DataFrame, order_by: str = "ordinal") -> DataFrame:
    """The column with the least value; the first in table order wins ties."""
    return parts.agg(
        F.min_by(F.struct("column", "value"), F.struct("value", order_by)).alias("w")
    ).select("w.column", "w.value")


def lowest_columns(parts: DataFrame, order_by: str = "ordinal", k: int = 10) -> DataFrame:
    return parts.orderBy("value", order_by).limit(k)


def with_ordinal(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the position of each row's column in the table."""
    return parts.withColumn("ordinal", F.array_position(F.array(*map(F.lit, names)), F.col("column")).cast("int"))

"""Score history: series, trends and statistics of stored scores.

All operators take ``as_of`` in place of a clock, work on every dataset at once, and reduce with
map-side combining; a single dataset is a filter that prunes partitions of the stored tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import mean2, round2

OVERALL_STEP = 5
DIMENSION_STEP = 2


def since(days: int, as_of: datetime | Column) -> Column:
    """The start of the window of ``days`` before ``as_of``."""
    if isinstance(as_of, Column):
        return as_of - F.make_dt_interval(days=F.lit(days))
    return F.lit(as_of - timedelta(days=days))


def score_history(scores: DataFrame, days: int, as_of: datetime | Column, dataset_id: str | None = None) -> DataFrame:
    """Scores of the window, oldest first, the dimension scores read back from their JSON text."""
    rows = scores.where(F.col("ts") >= since(days, as_of))
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    if dict(scores.dtypes)["dimension_scores"] == "string":
        rows = rows.withColumn("dimension_scores", F.from_json("dimension_scores", "map<string,double>"))
    return rows.select(
        "dataset_id", "ts", "overall_score", "total_records", "passed_rules", "failed_rules", "warnings",
        "dimension_scores",
    ).orderBy("ts", "dataset_id")


def dimension_trend(
    dim_scores: DataFrame, dimension: str, days: int, as_of: datetime | Column, dataset_id: str | None = None
) -> DataFrame:
    """``(dataset_id, ts, score)`` of one dimension, oldest first."""
    rows = dim_scores.where((F.col("dimension") == dimension) & (F.col("ts") >= since(days, as_of)))
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    return rows.select("dataset_id", "ts", "score").orderBy("ts", "dataset_id")


def _direction(change: Column, step: float) -> Column:
    return F.when(change > step, "improving").when(change < -step, "degrading").otherwise("stable")


def score_trend(scores: DataFrame, days: int, as_of: datetime | Column, datasets: DataFrame | None = None) -> DataFrame:
    """Newest against oldest score of the window per dataset. Every dataset of ``scores`` has a row, and every one of
    ``datasets`` (dataset_id), when ``scores`` may be read for the window only; with fewer than two points the trend
    is ``insufficient_data``."""
    if datasets is not None:
        scores = scores.select("dataset_id", "ts", "overall_score").unionByName(datasets.select("dataset_id"), allowMissingColumns=True)
    inside = F.coalesce(F.col("ts") >= since(days, as_of), F.lit(False))
    score = F.when(inside, F.col("overall_score"))
    at = F.when(inside, F.struct("ts", "overall_score"))  # of one instant the higher score is the newer
    ends = scores.groupBy("dataset_id").agg(
        F.count_if(inside).alias("data_points"),
        F.max_by(score, at).alias("newest"),
        F.min_by(score, at).alias("oldest"),
    )
    change, enough = F.col("newest") - F.col("oldest"), F.col("data_points") >= 2
    return ends.select(
        "dataset_id",
        F.when(enough, _direction(change, OVERALL_STEP)).otherwise("insufficient_data").alias("trend"),
        F.when(enough, round2(change)).otherwise(0.0).alias("change"),
        F.coalesce("newest", F.lit(0.0)).alias("current_score"),
        F.when(enough, F.col("oldest")).otherwise(0.0).alias("previous_score"),
        "data_points",
    )


def dimension_trends(dim_scores: DataFrame, days: int, as_of: datetime | Column) -> DataFrame:
    """The same per dimension, for those with at least two points."""
    change = F.col("current") - F.col("oldest")
    return (
        dim_scores.where(F.col("ts") >= since(days, as_of))
        .groupBy("dataset_id", "dimension")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.max_by("score", F.struct("ts", "score")).alias("current"),
            F.min_by("score", F.struct("ts", "score")).alias("oldest"),
        )
        .where(F.col("points") >= 2)
        .select(
            "dataset_id",
            "dimension",
            round2(change).alias("change"),
            "current",
            _direction(change, DIMENSION_STEP).alias("trend"),
        )
    )


def score_statistics(scores: DataFrame) -> DataFrame:
    """Latest and aggregate scores per dataset; no row for a dataset never assessed."""
    return scores.groupBy("dataset_id").agg(
        F.max_by("overall_score", F.struct("ts", "overall_score")).alias("latest_score"),
        F.max("ts").alias("latest_timestamp"),
        F.max_by("total_records", F.struct("ts", "overall_score", "total_records")).alias("latest_record_count"),
        mean2(F.col("overall_score")).alias("average_score"),
        F.min("overall_score").alias("min_score"),
        F.max("overall_score").alias("max_score"),
        F.count(F.lit(1)).alias("total_assessments"),
    )


def monitored_datasets(scores: DataFrame) -> DataFrame:
    """Datasets with their last assessment and number of assessments, newest first."""
    return (
        scores.groupBy("dataset_id", "dataset_name")
        .agg(F.max("ts").alias("last_assessed"), F.count(F.lit(1)).alias("assessment_count"))
        .orderBy(F.col("last_assessed").desc(), "dataset_id", "dataset_name")
    )

"""The report of a dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape
from plumbline.operators.alerts import recommendations, with_state
from plumbline.operators.exact import exact_groups, exact_members
from plumbline.operators.history import dimension_trends, score_trend
from plumbline.operators.shared import Shared
from plumbline.operators.profile import duplicate_profile, profile
from plumbline.plans.assess import assess

SHOWN_ALERTS = 10
TREND_WINDOW = 7


@dataclass(frozen=True)
class Report:
    """``document``: one nested row. ``duplicates``: all duplicate groups with their rows, however many,
    looked up when asked for."""

    document: DataFrame
    find_duplicates: Callable[[], DataFrame]

    @property
    def duplicates(self) -> DataFrame:
        return self.find_duplicates()


def quality_report(
    df: DataFrame,
    dataset_id: str,
    as_of: datetime,
    alerts: DataFrame,
    acks: DataFrame,
    scores: DataFrame,
    dim_scores: DataFrame,
    row_id: str,
    dataset_name: str | None = None,
    exclude: Sequence[str] = (),
) -> Report:
    """Assessment, profile, duplicate groups, alerts, recommendations and trend of a dataset.

    Alerts include acknowledged ones, the first ten by time are shown, all are counted for the
    recommendations. The document sums up the exact groups; their rows, which may be any number, are a
    table beside it. Nothing is stored.
    """
    exclude = [*exclude, row_id]
    shape = Shape.of(df, exclude)
    shared = Shared.of(df, shape, row_id)
    complete = shared.complete_sets(shape)
    assessed = assess(df, dataset_id, as_of, dataset_name, exclude=exclude, shared=shared)
    mine = with_state(alerts, acks).where(F.col("dataset_id") == dataset_id)
    advice = recommendations(assessed.dimension_scores.withColumn("dataset_id", F.lit(dataset_id)), mine)
    groups = exact_groups(df, shape.names, row_id, sets=complete)
    parts = [
        assessed.score.select(F.struct("*").alias("quality_score")),
        assessed.metrics.agg(_list(assessed.metrics).alias("metrics")),
        _profile_rows(df, exclude, shared),
        duplicate_profile(df, shape, complete).select(F.struct("duplicate_count", "duplicate_percentage").alias("duplicate_rows")),
        groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("records")).select(
            F.struct("groups", "records").alias("duplicate_totals")
        ),
        mine.orderBy("ts", "alert_id").limit(SHOWN_ALERTS).agg(_list(mine).alias("alerts")),
        advice.agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "recommendation"))), lambda r: r["recommendation"]
            ).alias("recommendations")
        ),
        score_trend(scores.where(F.col("dataset_id") == dataset_id), TREND_WINDOW, as_of).agg(
            F.first(F.struct("trend", "change", "current_score", "previous_score", "data_points")).alias("trend")
        ),
        dimension_trends(dim_scores.where(F.col("dataset_id") == dataset_id), TREND_WINDOW, as_of).agg(
            F.sort_array(F.collect_list(F.struct("dimension", "change", "current", "trend"))).alias("dimension_trends")
        ),
    ]
    report = df.sparkSession.range(1).select(
        F.sha2(F.concat_ws("|", F.lit(dataset_id), F.lit(as_of).cast("string")), 256).alias("report_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(dataset_name or dataset_id).alias("dataset_name"),
        F.lit(as_of).alias("generated_at"),
        F.lit(1).alias("__one"),
    )
    for part in parts:  # every part is a single row
        report = report.join(part.withColumn("__one", F.lit(1)), "__one", "left")

    def find_duplicates() -> DataFrame:
        members = exact_members(df, shape.names, row_id, sets=complete)
        return members.withColumnRenamed("row_id", row_id).join(df, row_id)

    return Report(report.drop("__one"), find_duplicates)


def _list(df: DataFrame):
    return F.collect_list(F.struct(*df.columns))


def _profile_rows(df: DataFrame, exclude: Sequence[str], shared: Shared) -> DataFrame:
    rows = profile(df, list(exclude), shared)
    in_order = F.struct("ordinal", *[c for c in rows.columns if c != "ordinal"])
    return rows.agg(F.sort_array(F.collect_list(in_order)).alias("profile"))

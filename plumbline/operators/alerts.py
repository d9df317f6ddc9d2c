"""Alerts: what is active, how many, since when, and what to do about it.

Alerts are append-only; an acknowledgement is a row in a table of its own. A cleared alert leaves the
live table, never the history.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.history import since
from plumbline.operators.scoring import DIMENSIONS

SEVERITIES = ("critical", "warning", "info")
TREND_DAYS = 3
MAX_RECOMMENDATIONS = 10

# Advice per dimension, given for a score below LOW_SCORE.
LOW_SCORE = 70
ADVICE = {
    "completeness": (
        "Add validation rules to require critical fields",
        "Investigate data collection processes for missing data",
        "Implement default value strategies where appropriate",
    ),
    "accuracy": (
        "Review and update data type constraints",
        "Implement input validation with appropriate formats",
        "Establish data quality rules for acceptable ranges",
    ),
    "consistency": (
        "Standardize data formats across all sources",
        "Implement reference data management",
        "Create data quality rules for cross-field validation",
    ),
    "uniqueness": (
        "Enable duplicate detection at data entry",
        "Implement master data management processes",
        "Review and merge duplicate records",
    ),
    "validity": (
        "Update business rule validations",
        "Implement lookup tables for valid values",
        "Review and correct invalid data records",
    ),
}
# Advice on critical alerts, on repeated rows and on missing values.
CRITICAL_ADVICE = "Address %d critical issues immediately to prevent data quality degradation"
UNIQUENESS_ADVICE = (95, "Consider implementing automated deduplication processes to improve data uniqueness")
COMPLETENESS_ADVICE = (80, "Implement mandatory field validation at data entry points to improve completeness")


def with_state(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """All alerts with ``acknowledged``."""
    known = acks.select("alert_id").distinct().withColumn("__ack", F.lit(True))
    return alerts.join(known, "alert_id", "left").withColumn(
        "acknowledged", F.coalesce("__ack", F.lit(False))
    ).drop("__ack")


def acknowledgement(alerts: DataFrame, alert_id: str, ts: datetime) -> DataFrame:
    """The acknowledgement row to append: one for a known alert, none for an unknown one."""
    return alerts.where(F.col("alert_id") == alert_id).select("alert_id", F.lit(ts).alias("ts")).limit(1)


def active_alerts(
    alerts: DataFrame, acks: DataFrame, severity: str | None = None, dataset_id: str | None = None
) -> DataFrame:
    """Alerts not acknowledged, newest first."""
    rows = alerts
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    return rows.join(acks, "alert_id", "left_anti").orderBy(F.col("ts").desc(), "alert_id")


def alert_summary(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """One row: active alerts in all, by severity (zeros kept), by dimension (present ones), oldest, newest."""
    active = alerts.join(acks, "alert_id", "left_anti")
    one = F.lit(1)
    stats = active.agg(
        F.count(one).alias("total_active"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        *[F.count_if(F.col("dimension") == d).alias(f"__{d}") for d in DIMENSIONS],
        F.min("ts").alias("oldest_alert"),
        F.max("ts").alias("newest_alert"),
    )
    pairs = F.create_map(*[part for d in DIMENSIONS for part in (F.lit(d), F.col(f"__{d}"))])
    return stats.select(
        "total_active", *SEVERITIES, F.map_filter(pairs, lambda _, n: n > 0).alias("by_dimension"),
        "oldest_alert", "newest_alert",
    )


def alert_daily(alerts: DataFrame, days: int, as_of: datetime | Column) -> DataFrame:
    """``(day, total, critical, warning, info)`` for the days of the window that have alerts."""
    return (
        alerts.where(F.col("ts") >= since(days, as_of))
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        )
    )


def alert_trend(alerts: DataFrame, days: int, as_of: datetime | Column) -> DataFrame:
    """One row: alerts in the window, days with any, and the trend of the last three such days against
    the first three: stable below two days, increasing only if strictly more."""
    daily = alert_daily(alerts, days, as_of).agg(
        # at most one entry per day of the window
        F.sort_array(F.collect_list(F.struct("day", "total"))).alias("d")
    )
    n = F.size("d")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x["total"]) / F.size(part)
    first = F.slice("d", 1, TREND_DAYS)
    last = F.slice(F.col("d"), F.greatest(n - TREND_DAYS + 1, F.lit(1)), F.lit(TREND_DAYS))
    trend = F.when(n < 2, "stable").when(mean(last) > mean(first), "increasing").otherwise("decreasing")
    total = F.aggregate("d", F.lit(0).cast("bigint"), lambda s, x: s + x["total"])
    return daily.select(
        F.lit(days).alias("period_days"), total.alias("total_alerts"), n.alias("days_with_alerts"),
        trend.alias("trend"),
    )


def recommendations(scores: DataFrame, alerts: DataFrame) -> DataFrame:
    """``(dataset_id, position, recommendation)``: up to ten pieces of advice per dataset, from its
    dimension scores ``(dataset_id, dimension, score)`` and its critical alerts."""
    spark = scores.sparkSession
    table = spark.createDataFrame(
        [(d, LOW_SCORE, 10 * i + j, text) for i, (d, texts) in enumerate(ADVICE.items()) for j, text in enumerate(texts)]
        + [("uniqueness", UNIQUENESS_ADVICE[0], 1001, UNIQUENESS_ADVICE[1])]
        + [("completeness", COMPLETENESS_ADVICE[0], 1002, COMPLETENESS_ADVICE[1])],
        "dimension string, below int, place int, recommendation string",
    )
    by_score = (
        scores.join(F.broadcast(table), "dimension")  # the fixed texts above
        .where(F.col("score") < F.col("below"))
        .select("dataset_id", "place", "recommendation")
    )
    critical = (
        alerts.where(F.col("severity") == "critical")
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(scores.select("dataset_id").distinct(), "dataset_id", "left_semi")
        .select("dataset_id", F.lit(1000).alias("place"), F.format_string(CRITICAL_ADVICE, "n").alias("recommendation"))
    )
    order = Window.partitionBy("dataset_id").orderBy("place")
    return (
        by_score.unionByName(critical)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= MAX_RECOMMENDATIONS)
        .select("dataset_id", "position", "recommendation")
    )


def retained_alerts(alerts: DataFrame, acks: DataFrame, days: int, as_of: datetime | Column) -> DataFrame:
    """The live alerts left after clearing those both acknowledged and older than the window."""
    keep = ~F.col("acknowledged") | (F.col("ts") >= since(days, as_of))
    return with_state(alerts, acks).where(keep)


def cleared_count(alerts: DataFrame, acks: DataFrame, days: int, as_of: datetime | Column) -> DataFrame:
    """One row: how many alerts clearing removes."""
    gone = F.col("acknowledged") & (F.col("ts") < since(days, as_of))
    return with_state(alerts, acks).agg(F.count_if(gone).alias("cleared"))

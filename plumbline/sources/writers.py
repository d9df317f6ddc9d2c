"""Tables of scores and alerts that grow by assessments, and the report document.

Rows are laid out by data set, day and assessment (its time). Recording an assessment replaces the partitions of that
assessment and no other, so a recording that failed halfway, or is repeated, leaves one copy (a reader opened before
has to be opened again); readers that ask for a window of time open the days of that window only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.alerts import acknowledgement
from plumbline.plans.assess import Assessment
from plumbline.plans.report import Report


#: Folders of the stored tables, one in the other.
LAYOUT = ("dataset_id", "day", "assessed")


def score_rows(score: DataFrame) -> DataFrame:
    """Score rows as stored: the dimension scores as JSON text."""
    return score.withColumn("dimension_scores", F.to_json("dimension_scores"))


def dimension_rows(score: DataFrame) -> DataFrame:
    """``(dataset_id, ts, dimension, score)``, one row per dimension score."""
    return score.select("dataset_id", "ts", F.explode("dimension_scores").alias("dimension", "score"))


def record(assessment: Assessment, folder: str) -> None:
    """Put an assessment's score, dimension scores and alerts below ``folder``; again changes nothing."""
    record_rows(score_rows(assessment.score), f"{folder}/scores")
    record_rows(dimension_rows(assessment.score), f"{folder}/dimension_scores")
    record_rows(assessment.alerts, f"{folder}/alerts")


def acknowledge(alerts: DataFrame, alert_id: str, ts: datetime, folder: str) -> bool:
    """Append an acknowledgement; False for an unknown alert."""
    row = acknowledgement(alerts, alert_id, ts)
    if row.isEmpty():
        return False
    row.coalesce(1).write.mode("append").parquet(f"{folder}/alert_acks")
    return True


def record_rows(rows: DataFrame, path: str) -> None:
    """Put rows (dataset_id, ts, ...) of any number of assessments of any data sets below ``path`` in one job, in the
    place of what is there of the same assessments."""
    laid = rows.withColumns({"day": F.to_date("ts"), "assessed": F.date_format("ts", "HH-mm-ss-SSSSSS")})
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def write_report(report: Report, folder: str) -> None:
    """The nested row as a JSON document, and the rows of all duplicate groups as JSON lines beside it."""
    report.document.coalesce(1).write.mode("overwrite").json(f"{folder}/document")
    report.duplicates.write.mode("overwrite").json(f"{folder}/duplicates")

"""Queries over score history and alerts. The history is a grouped assessment: every event type is a
dataset, every day one assessment of it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import rounded, share, string
from plumbline.operators import alerts as al
from plumbline.operators import history as hi
from plumbline.operators.rules import RULE_SCHEMA, alerts_of, judge, verdicts
from plumbline.operators.scoring import overall_score
from plumbline.sources.writers import dimension_rows, score_rows
from workload.sql import WEIGHT, big, collection, rnd, union, with_views
from workload.views import table, view

QUERIES, ORACLES, query = collection()

RULES = [
    ("complete", "Complete", "completeness", "", None, 90.0, "warning", True, {}),
    ("accurate", "Accurate", "accuracy", "", None, 95.0, "info", True, {}),
    ("valid", "Valid", "validity", "", None, 85.0, "critical", True, {}),
]
DATASET = "purchase"

# ---- inputs


def dim_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``(dataset_id, ts, dimension, score)`` of every dataset and day."""
    values = {
        "completeness": share("non_null_values", "total_records", 0),
        "accuracy": f"100 - {share('high_values', 'total_records', 0)}",
        "validity": f"100 - {share('flagged', 'total_records', 0)}",
    }
    pairs = F.expr(f"map({', '.join(f'{string(d)}, {rounded(v)}' for d, v in values.items())})")
    days = view(spark, sf, "score_days")
    return days.select("dataset_id", F.col("day").cast("timestamp").alias("ts"), "total_records", F.explode(pairs).alias("dimension", "score"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return judge(spark.createDataFrame(RULES, RULE_SCHEMA), dim_scores(spark, sf), keys=["dataset_id", "ts"])


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """The stored score rows of that history."""
    keys, dims = ["dataset_id", "ts"], dim_scores(spark, sf)
    packed = dims.groupBy(*keys).agg(
        F.first("total_records").alias("total_records"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "score")))).alias("dimension_scores"),
    )
    joined = packed.join(overall_score(dims, keys), keys).join(verdicts(judged(spark, sf), keys), keys)
    return score_rows(joined.withColumn("dataset_name", F.col("dataset_id")))


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = alerts_of(judged(spark, sf), F.col("dataset_id"), F.col("ts"))
    readable = F.concat_ws("|", "dataset_id", F.date_format("ts", "yyyy-MM-dd"), "rule_id")
    return rows.withColumn("alert_id", readable)


def acks(spark: SparkSession, sf: str) -> DataFrame:
    return stored_alerts(spark, sf).where(F.dayofmonth("ts") % 3 == 0).select("alert_id", "ts")


def as_of(spark: SparkSession, sf: str) -> datetime:
    last = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return datetime(last.year, last.month, last.day) + timedelta(days=1)


_DIMS = union(
    f"SELECT dataset_id, day AS ts, total_records, '{d}' AS dimension, {rnd(v)} AS score FROM score_days"
    for d, v in (
        ("completeness", "non_null_values * 100.0 / total_records"),
        ("accuracy", "100 - high_values * 100.0 / total_records"),
        ("validity", "100 - flagged * 100.0 / total_records"),
    )
)
_RULE_ROWS = ", ".join(f"('{i}', '{n}', '{d}', CAST({t} AS DOUBLE), '{s}')" for i, n, d, _, _, t, s, _, _ in RULES)
BASE = with_views(
    ["score_days"],
    f"dims AS ({_DIMS})",
    f"rules(rule_id, rule_name, dimension, threshold, severity) AS (VALUES {_RULE_ROWS})",
    "judged AS (SELECT d.*, r.rule_id, r.rule_name, r.threshold, r.severity, d.score < r.threshold AS failed "
    "FROM dims d JOIN rules r USING (dimension))",
    f"""scores AS (SELECT s.*, v.passed_rules, v.failed_rules, v.warnings FROM (SELECT dataset_id, ts,
    any_value(total_records) AS total_records, {rnd(f'sum(score * {WEIGHT}) / sum({WEIGHT})')} AS overall_score
    FROM dims GROUP BY dataset_id, ts) s JOIN (SELECT dataset_id, ts, count(*) FILTER (NOT failed) AS passed_rules,
    count(*) FILTER (failed) AS failed_rules, count(*) FILTER (failed AND severity = 'warning') AS warnings
    FROM judged GROUP BY dataset_id, ts) v USING (dataset_id, ts))""",
    """alerts AS (SELECT dataset_id || '|' || strftime(ts, '%Y-%m-%d') || '|' || rule_id AS alert_id, ts, severity, rule_id,
    rule_name, dimension, dataset_id, score AS metric_value, threshold, day(ts) % 3 = 0 AS acknowledged
    FROM judged WHERE failed)""",
    "clock AS (SELECT CAST(max(CAST(ts AS DATE)) + 1 AS TIMESTAMP) AS as_of FROM events)",
)


def _within(days: int) -> str:
    return f"ts >= (SELECT as_of FROM clock) - INTERVAL {days} DAY"


# ---- history


@query(
    "score_history",
    BASE + f"""SELECT s.dataset_id, s.ts, overall_score, s.total_records, passed_rules, failed_rules, warnings,
    c.score AS completeness, a.score AS accuracy, v.score AS validity FROM scores s
    JOIN dims c ON c.dataset_id = s.dataset_id AND c.ts = s.ts AND c.dimension = 'completeness'
    JOIN dims a ON a.dataset_id = s.dataset_id AND a.ts = s.ts AND a.dimension = 'accuracy'
    JOIN dims v ON v.dataset_id = s.dataset_id AND v.ts = s.ts AND v.dimension = 'validity'
    WHERE s.dataset_id = '{DATASET}' AND s.{_within(20)} ORDER BY s.ts""",
)
def _(spark, sf):
    rows = hi.score_history(scores(spark, sf), 20, as_of(spark, sf), DATASET)
    split = [F.col("dimension_scores")[d].alias(d) for d in ("completeness", "accuracy", "validity")]
    return rows.select("*", *split).drop("dimension_scores")


@query("score_sink", BASE + "SELECT dataset_id, ts, dimension, score FROM dims")
def _(spark, sf):
    """The rows of the dimension score sink, taken from the stored JSON."""
    stored = scores(spark, sf).withColumn("dimension_scores", F.from_json("dimension_scores", "map<string,double>"))
    return dimension_rows(stored)


@query(
    "dimension_trend",
    BASE + f"SELECT dataset_id, ts, score FROM dims WHERE dimension = 'accuracy' AND dataset_id = '{DATASET}' AND {_within(30)}",
)
def _(spark, sf):
    return hi.dimension_trend(dim_scores(spark, sf), "accuracy", 30, as_of(spark, sf), DATASET)


@query(
    "score_trend",
    BASE + f"""SELECT dataset_id, CASE WHEN data_points < 2 THEN 'insufficient_data' WHEN newest - oldest > 5 THEN 'improving'
    WHEN newest - oldest < -5 THEN 'degrading' ELSE 'stable' END AS trend,
    CASE WHEN data_points < 2 THEN 0 ELSE {rnd('newest - oldest')} END AS change, coalesce(newest, 0) AS current_score,
    CASE WHEN data_points < 2 THEN 0 ELSE oldest END AS previous_score, data_points FROM (
    SELECT dataset_id, count(*) FILTER (w) AS data_points, max_by(overall_score, ts) FILTER (w) AS newest,
    min_by(overall_score, ts) FILTER (w) AS oldest FROM (SELECT *, {_within(7)} AS w FROM scores) GROUP BY dataset_id)""",
)
def _(spark, sf):
    return hi.score_trend(scores(spark, sf), 7, as_of(spark, sf))


@query(
    "dimension_trends",
    BASE + f"""SELECT dataset_id, dimension, {rnd('newest - oldest')} AS change, newest AS current,
    CASE WHEN newest - oldest > 2 THEN 'improving' WHEN newest - oldest < -2 THEN 'degrading' ELSE 'stable' END AS trend
    FROM (SELECT dataset_id, dimension, max_by(score, ts) AS newest, min_by(score, ts) AS oldest FROM dims
    WHERE {_within(7)} GROUP BY ALL HAVING count(*) >= 2)""",
)
def _(spark, sf):
    return hi.dimension_trends(dim_scores(spark, sf), 7, as_of(spark, sf))


@query(
    "score_statistics",
    BASE + f"""SELECT dataset_id, max_by(overall_score, ts) AS latest_score, max(ts) AS latest_timestamp,
    max_by(total_records, ts) AS latest_record_count, {rnd('avg(CAST(overall_score AS DECIMAL(18, 2)))')} AS average_score,
    min(overall_score) AS min_score, max(overall_score) AS max_score, count(*) AS total_assessments
    FROM scores GROUP BY dataset_id""",
)
def _(spark, sf):
    return hi.score_statistics(scores(spark, sf))


@query(
    "monitored_datasets",
    BASE + """SELECT dataset_id, dataset_id AS dataset_name, max(ts) AS last_assessed, count(*) AS assessment_count
    FROM scores GROUP BY dataset_id ORDER BY last_assessed DESC""",
)
def _(spark, sf):
    return hi.monitored_datasets(scores(spark, sf))


# ---- alerts

_ALERT = "alert_id, ts, severity, rule_id, rule_name, dimension, dataset_id, metric_value, threshold"
_ALERT_COLUMNS = _ALERT.split(", ")


@query("active_alerts", BASE + f"SELECT {_ALERT} FROM alerts WHERE NOT acknowledged ORDER BY ts DESC")
def _(spark, sf):
    return al.active_alerts(stored_alerts(spark, sf), acks(spark, sf)).select(*_ALERT_COLUMNS)


@query(
    "active_alerts_filtered",
    BASE + f"SELECT {_ALERT} FROM alerts WHERE NOT acknowledged AND severity = 'critical' AND dataset_id = '{DATASET}'",
)
def _(spark, sf):
    return al.active_alerts(stored_alerts(spark, sf), acks(spark, sf), "critical", DATASET).select(*_ALERT_COLUMNS)


@query("all_alerts", BASE + f"SELECT {_ALERT}, acknowledged FROM alerts")
def _(spark, sf):
    return al.with_state(stored_alerts(spark, sf), acks(spark, sf)).select(*_ALERT_COLUMNS, "acknowledged")


@query(
    "alert_summary",
    BASE + """SELECT count(*) AS total_active, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
    count(*) FILTER (dimension = 'completeness') AS completeness, count(*) FILTER (dimension = 'accuracy') AS accuracy,
    count(*) FILTER (dimension = 'validity') AS validity, min(ts) AS oldest_alert, max(ts) AS newest_alert
    FROM alerts WHERE NOT acknowledged""",
)
def _(spark, sf):
    rows = al.alert_summary(stored_alerts(spark, sf), acks(spark, sf))
    split = [F.coalesce(F.col("by_dimension")[d], F.lit(0)).alias(d) for d in ("completeness", "accuracy", "validity")]
    return rows.select("*", *split).drop("by_dimension")


_DAILY = f"""SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info
FROM alerts WHERE {_within(10)} GROUP BY 1"""


@query("alert_daily", BASE + _DAILY)
def _(spark, sf):
    return al.alert_daily(stored_alerts(spark, sf), 10, as_of(spark, sf))


@query(
    "alert_trend",
    BASE + f""", daily AS ({_DAILY}), ranked AS (SELECT total, row_number() OVER (ORDER BY day) AS first,
    row_number() OVER (ORDER BY day DESC) AS last FROM daily)
    SELECT 10 AS period_days, {big('sum(total)')} AS total_alerts, CAST(count(*) AS INTEGER) AS days_with_alerts,
    CASE WHEN count(*) < 2 THEN 'stable' WHEN avg(total) FILTER (last <= 3) > avg(total) FILTER (first <= 3)
    THEN 'increasing' ELSE 'decreasing' END AS trend FROM ranked""",
)
def _(spark, sf):
    return al.alert_trend(stored_alerts(spark, sf), 10, as_of(spark, sf))


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest dimension scores of every dataset, twenty points stricter to give advice something to say."""
    latest = dim_scores(spark, sf).groupBy("dataset_id", "dimension").agg(F.max_by("score", "ts").alias("score"))
    return latest.withColumn("score", F.bround(F.col("score") - 20, 2))


ADVICE = ", ".join(
    f"('{d}', {al.LOW_SCORE}, {10 * i + j}, '{text}')"
    for i, (d, texts) in enumerate(al.ADVICE.items())
    for j, text in enumerate(texts)
) + f", ('uniqueness', 95, 1001, '{al.UNIQUENESS_ADVICE[1]}'), ('completeness', 80, 1002, '{al.COMPLETENESS_ADVICE[1]}')"


@query(
    "recommendations",
    BASE + f""", advice(dimension, below, place, recommendation) AS (VALUES {ADVICE}),
    latest AS (SELECT dataset_id, dimension, {rnd('max_by(score, ts) - 20')} AS score FROM dims GROUP BY ALL),
    found AS (SELECT dataset_id, place, recommendation FROM latest JOIN advice USING (dimension) WHERE score < below
      UNION ALL SELECT dataset_id, 1000, 'Address ' || count(*) || ' critical issues immediately to prevent data quality degradation'
      FROM alerts WHERE severity = 'critical' GROUP BY dataset_id)
    SELECT dataset_id, CAST(position AS INTEGER) AS position, recommendation FROM (SELECT *, row_number() OVER (
    PARTITION BY dataset_id ORDER BY place) AS position FROM found) WHERE position <= 10""",
)
def _(spark, sf):
    return al.recommendations(_latest(spark, sf), stored_alerts(spark, sf))


@query("retained_alerts", BASE + f"SELECT {_ALERT}, acknowledged FROM alerts WHERE NOT acknowledged OR {_within(10)}")
def _(spark, sf):
    rows = al.retained_alerts(stored_alerts(spark, sf), acks(spark, sf), 10, as_of(spark, sf))
    return rows.select(*_ALERT_COLUMNS, "acknowledged")


@query("cleared_alerts", BASE + f"SELECT count(*) AS cleared FROM alerts WHERE acknowledged AND NOT ({_within(10)})")
def _(spark, sf):
    return al.cleared_count(stored_alerts(spark, sf), acks(spark, sf), 10, as_of(spark, sf))

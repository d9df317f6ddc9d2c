"""Queries through stored scores, alerts and reports: two assessments of the customers are recorded and read back."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_as_null
from plumbline.operators import alerts as al
from plumbline.operators import drill
from plumbline.operators.history import score_trend
from plumbline.plans.assess import assess
from plumbline.plans.report import Report, quality_report
from plumbline.session import shared_folder
from plumbline.sources.readers import PageIndex, read_acknowledgements, read_stored, read_table, stored_datasets
from plumbline.sources.writers import acknowledge, record, write_report
from workload.checks import AS_OF, ORDERS, SCORED, V1, dirty_assessment
from workload.dedup import COMPLETE, SETS
from workload.monitoring import ADVICE
from workload.sql import DIRTY, WEIGHT, big, collection, rnd, table_metrics, with_views
from workload.views import table, view

QUERIES, ORACLES, query = collection()

BEFORE = AS_OF - timedelta(days=3)
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
DIMS = ("accuracy", "completeness", "consistency", "uniqueness", "validity")
#: The rule whose alert is acknowledged.
ACKNOWLEDGED = "r1"

# ---- the stored history; the oracle rounds the mean of two-decimal values on whole hundredths, ties to even


def history(spark: SparkSession, sf: str) -> str:
    """A folder with two assessments of the data set ``customers``: the given table and, later, the dirty one,
    whose alert on completeness is acknowledged."""
    folder = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    record(assess(table(spark, sf, "customer"), "customers", BEFORE), folder)
    dirty = dirty_assessment(spark, sf)
    record(dirty, folder)
    record(dirty, folder)  # a second time changes nothing
    stored = read_stored(spark, folder, "alerts")
    for known in stored.where(F.col("rule_id") == ACKNOWLEDGED).select("alert_id").limit(1).collect():
        assert acknowledge(stored, known["alert_id"], AS_OF, folder)
    assert not acknowledge(stored, "unknown", AS_OF, folder)
    return folder


_BOTH = f"""customer_metrics AS ({table_metrics(
    "customer", CUSTOMER, ["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"], [], [], [], [],
)}),
dims AS (
  SELECT TIMESTAMP '{BEFORE}' AS ts, dimension, CAST(cents // n + (cents % n * 2 > n OR (cents % n * 2 = n AND cents // n % 2 = 1))::BIGINT AS DOUBLE) / 100
    AS score FROM (SELECT dimension, {big('sum(round(value * 100))')} AS cents, count(*) AS n FROM customer_metrics GROUP BY dimension)
  UNION ALL SELECT TIMESTAMP '{AS_OF}', dimension, score FROM scores),
stored AS (
  SELECT ts, {rnd(f'sum(score * {WEIGHT}) / sum({WEIGHT})')} AS overall_score FROM dims GROUP BY ts),
alerts AS (SELECT sha256('customers|{AS_OF}|' || rule_id) AS alert_id, TIMESTAMP '{AS_OF}' AS ts, severity, rule_id,
  name AS rule_name, dimension, name || ' failed: Score ' || score::VARCHAR || '% below threshold ' || threshold::VARCHAR || '%'
  AS message, 'customers' AS dataset_id, score AS metric_value, threshold, CASE WHEN rule_id = 'r1' THEN 'crm' END AS owner
  FROM judged WHERE score < threshold)
"""
BASE = SCORED + ", " + _BOTH


@query(
    "stored_scores",
    BASE + f"""SELECT 'customers' AS dataset_id, 'customers' AS dataset_name, ts, overall_score,
    CASE WHEN ts = TIMESTAMP '{BEFORE}' THEN (SELECT count(*) FROM customer) ELSE (SELECT count(*) FROM dirty_customer) END AS total_records,
    CASE WHEN ts = TIMESTAMP '{BEFORE}' THEN 0 ELSE (SELECT count(*) FROM judged WHERE score >= threshold) END AS passed_rules,
    CASE WHEN ts = TIMESTAMP '{BEFORE}' THEN 0 ELSE (SELECT count(*) FROM judged WHERE score < threshold) END AS failed_rules,
    CASE WHEN ts = TIMESTAMP '{BEFORE}' THEN 0 ELSE (SELECT count(*) FROM judged WHERE score < threshold AND severity = 'warning') END AS warnings,
    """ + ", ".join(f"(SELECT score FROM dims d WHERE d.ts = s.ts AND dimension = '{d}') AS {d}" for d in DIMS) + " FROM stored s",
)
def _(spark, sf):
    """Recorded score rows with their dimension scores, read back."""
    rows = read_stored(spark, history(spark, sf), "scores")
    packed = F.from_json("dimension_scores", "map<string,double>")
    return rows.select("*", *[packed[d].alias(d) for d in DIMS]).drop("dimension_scores")


@query("stored_dimension_scores", BASE + "SELECT 'customers' AS dataset_id, ts, dimension, score FROM dims")
def _(spark, sf):
    return read_stored(spark, history(spark, sf), "dimension_scores")


@query("stored_alerts", BASE + "SELECT * FROM alerts")
def _(spark, sf):
    """Appended alerts with all their columns; of the details the owner."""
    rows = read_stored(spark, history(spark, sf), "alerts")
    return rows.withColumn("owner", F.col("details")["owner"]).drop("details")


@query("acknowledged_alerts", BASE + f"SELECT alert_id, rule_id, rule_id = '{ACKNOWLEDGED}' AS acknowledged FROM alerts")
def _(spark, sf):
    folder = history(spark, sf)
    rows = al.with_state(read_stored(spark, folder, "alerts"), read_acknowledgements(spark, folder))
    return rows.select("alert_id", "rule_id", "acknowledged")


@query(
    "stored_trend",
    BASE + f"""SELECT 'customers' AS dataset_id, CASE WHEN newest - oldest > 5 THEN 'improving' WHEN newest - oldest < -5 THEN 'degrading'
    ELSE 'stable' END AS trend, {rnd('newest - oldest')} AS change, newest AS current_score, oldest AS previous_score, CAST(2 AS BIGINT) AS data_points
    FROM (SELECT max_by(overall_score, ts) AS newest, min_by(overall_score, ts) AS oldest FROM stored)""",
)
def _(spark, sf):
    """The trend of a window of days, from the folders of these days."""
    folder, days = history(spark, sf), 7
    rows = read_stored(spark, folder, "scores", since=AS_OF - timedelta(days=days))
    return score_trend(rows, days, AS_OF, stored_datasets(spark, folder))


@query(
    "deep_page",
    """SELECT *, (SELECT count(*) FROM lineitem) AS total_rows FROM lineitem
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice LIMIT 50 OFFSET (SELECT count(*) // 2 FROM lineitem)""",
)
def _(spark, sf):
    """A page from the middle of the order lines, by position."""
    lines = table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    index = PageIndex.of(lines, order, f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}")
    return index.page(50, index.total // 2)


# ---- report


def report(spark: SparkSession, sf: str) -> Report:
    """The report of the dirty customers with the stored history of that data set."""
    folder = history(spark, sf)
    stored = read_stored(spark, folder, "scores")
    return quality_report(
        view(spark, sf, "dirty_customer"), "customers", AS_OF, read_stored(spark, folder, "alerts"), read_acknowledgements(spark, folder),
        stored.withColumn("dimension_scores", F.from_json("dimension_scores", "map<string,double>")),
        read_stored(spark, folder, "dimension_scores"), row_id="row_id",
    )


def _lines(column: str, value) -> F.Column:
    return F.concat_ws(";", F.transform(F.col(column), value))


def flat(document: DataFrame) -> DataFrame:
    """The nested document as plain columns; lists are joined."""
    order = F.sort_array
    return document.select(
        "report_id", "dataset_id", "dataset_name", F.col("generated_at").cast("timestamp").alias("generated_at"),
        F.col("quality_score.overall_score").alias("overall_score"), F.col("quality_score.total_records").alias("total_records"),
        F.concat_ws(";", order(F.transform("metrics", lambda m: F.when(m["column"].isNull(), m["name"])))).alias("metrics"),
        _lines("profile", lambda p: F.concat_ws(":", p["column"], p["null_count"].cast("string"), p["unique_count"].cast("string"))).alias("profile"),
        "duplicate_rows.duplicate_count", "duplicate_rows.duplicate_percentage",
        F.col("duplicate_totals.groups").alias("duplicate_groups"), F.col("duplicate_totals.records").alias("duplicate_records"),
        F.concat_ws(";", order(F.transform("alerts", lambda a: F.concat_ws(":", a["rule_id"], a["acknowledged"].cast("string"))))).alias("alerts"),
        F.concat_ws(";", "recommendations").alias("recommendations"),
        "trend.trend", "trend.change", "trend.current_score", "trend.previous_score", F.col("trend.data_points").alias("data_points"),
        _lines("dimension_trends", lambda d: F.concat_ws(":", d["dimension"], d["trend"])).alias("dimension_trends"),
    )


_COUNTS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}:' || (count(*) - count({c})) || ':' || count(DISTINCT {c}) AS line FROM dirty_customer" for i, c in enumerate(DIRTY)
)
_REPORT = BASE + f""", {SETS}, advice(dimension, below, place, recommendation) AS (VALUES {ADVICE}),
found AS (SELECT place, recommendation FROM scores JOIN advice USING (dimension) WHERE score < below
  UNION ALL SELECT 1000, 'Address ' || count(*) || ' critical issues immediately to prevent data quality degradation'
  FROM alerts WHERE severity = 'critical' HAVING count(*) > 0),
ends AS (SELECT max_by(overall_score, ts) AS newest, min_by(overall_score, ts) AS oldest FROM stored),
moved AS (SELECT dimension, max_by(score, ts) - min_by(score, ts) AS change FROM dims GROUP BY dimension HAVING count(*) > 1),
extra AS (SELECT count(*) - count(DISTINCT ({', '.join(DIRTY)})) AS n FROM dirty_customer WHERE {COMPLETE})
SELECT sha256('customers|{AS_OF}') AS report_id, 'customers' AS dataset_id, 'customers' AS dataset_name,
  TIMESTAMP '{AS_OF}' AS generated_at, overall_score, (SELECT count(*) FROM dirty_customer) AS total_records,
  (SELECT string_agg(name, ';' ORDER BY name) FROM metrics) AS metrics,
  (SELECT string_agg(line, ';' ORDER BY place) FROM ({_COUNTS})) AS profile,
  (SELECT n FROM extra) AS duplicate_count,
  (SELECT {rnd('n * 100.0 / (SELECT count(*) FROM dirty_customer)')} FROM extra) AS duplicate_percentage,
  (SELECT count(*) FROM sets) AS duplicate_groups, (SELECT {big('coalesce(sum(size), 0)')} FROM sets) AS duplicate_records,
  (SELECT coalesce(string_agg(rule_id || ':' || (rule_id = '{ACKNOWLEDGED}'), ';' ORDER BY rule_id), '') FROM alerts) AS alerts,
  (SELECT coalesce(string_agg(recommendation, ';' ORDER BY place), '') FROM (SELECT * FROM found ORDER BY place LIMIT 10)) AS recommendations,
  CASE WHEN newest - oldest > 5 THEN 'improving' WHEN newest - oldest < -5 THEN 'degrading' ELSE 'stable' END AS trend,
  {rnd('newest - oldest')} AS change, newest AS current_score, oldest AS previous_score, CAST(2 AS BIGINT) AS data_points,
  (SELECT string_agg(dimension || ':' || CASE WHEN change > 2 THEN 'improving' WHEN change < -2 THEN 'degrading' ELSE 'stable' END,
   ';' ORDER BY dimension) FROM moved) AS dimension_trends
FROM overall, ends"""


@query("quality_report", _REPORT)
def _(spark, sf):
    """The report of one data set and its stored history, flattened."""
    return flat(report(spark, sf).document)


@query("stored_report", f"SELECT r.*, (SELECT coalesce(sum(size), 0) FROM ({with_views(['dirty_customer'])}, {SETS} SELECT size FROM sets))::BIGINT AS stored_rows FROM ({_REPORT}) r")
def _(spark, sf):
    """The report written as a document and read back, with the number of its stored duplicate rows."""
    folder, written = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}", report(spark, sf)
    write_report(written, folder)
    document = spark.read.schema(written.document.schema).json(f"{folder}/document")
    kept = spark.read.schema(written.duplicates.schema).json(f"{folder}/duplicates").agg(F.count(F.lit(1)).alias("stored_rows"))
    return flat(document).crossJoin(kept)  # single rows


# ---- sources and rows without a file of their own


@query("table_source", f"SELECT {', '.join(ORDERS)} FROM orders")
def _(spark, sf):
    return read_table(spark, f"{sf}/orders.parquet").select(*ORDERS)


@query("nan_rendering", f"SELECT {', '.join(c for c in ORDERS if c != 'o_totalprice')}, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def _(spark, sf):
    """Prices that are not a number read as missing."""
    price = F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return nan_as_null(table(spark, sf, "orders").select(*ORDERS).withColumn("o_totalprice", price))


@query(
    "rows_guarded",
    V1 + """SELECT 0 AS shown, 0 AS offenders, 'Unknown kind of rows: typo' AS explanation UNION ALL
    SELECT 0, 0, 'No numeric column specified for outlier detection' UNION ALL
    SELECT least(n, 100)::INT, n::INT, 'Found ' || n || ' records with missing values in ''email''' FROM (
    SELECT count(*) AS n FROM dirty_customer WHERE email IS NULL)""",
)
def _(spark, sf):
    """Neither an unknown kind of rows nor outliers of a text have any rows, beside a kind that has."""
    parts = []
    for kind in ("typo", "outliers", "missing"):
        count, text, shown = drill.explained(view(spark, sf, "dirty_customer"), kind, "email", ["row_id"])
        parts.append(shown.agg(F.count(F.lit(1)).cast("int").alias("shown")).select("shown", F.lit(count).alias("offenders"), F.lit(text).alias("explanation")))
    return parts[0].union(parts[1]).union(parts[2])

"""Queries over single tables: sources, drill-downs, checks, scores, rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, nan_as_null
from plumbline.functions.text import FORMATS
from plumbline.operators import accuracy, completeness, consistency, drill, scoring, uniqueness, validity
from plumbline.operators.check import Check, run_checks
from plumbline.operators.rules import RULE_SCHEMA
from plumbline.plans.assess import Assessment, assess, assess_groups, quartile_pairs
from plumbline.sources.readers import dataset_info, sample_page
from workload.sql import (
    DIRTY, DIRTY_METRICS, TEXT, WEIGHT, big, collection, fences, mixed_case, rnd, table_metrics, union, with_views,
)
from workload.views import table, view

AS_OF = datetime(2024, 1, 31)
V1 = with_views(["dirty_customer"])
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NUMERIC_LINE = LINEITEM[:8]

QUERIES, ORACLES, query = collection()


def dirty(spark: SparkSession, sf: str) -> tuple[DataFrame, Shape]:
    df = nan_as_null(view(spark, sf, "dirty_customer"))
    return df, Shape.of(df, ["row_id"])


def whole(rows: DataFrame, *columns: str) -> DataFrame:
    """The metric itself, without its parts."""
    return rows.where(F.col("column").isNull()).select(*columns)


def parts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.where(F.col("column").isNotNull()).select(*columns)


def check(df: DataFrame, one: Check) -> DataFrame:
    return run_checks(df, [one])


# ---- sources


@query(
    "dataset_info",
    f"""SELECT 'orders' AS dataset_id, count(*) AS rows, 6 AS columns, '{",".join(ORDERS)}' AS column_names,
    'bigint,bigint,string,double,timestamp_ntz,string' AS dtypes FROM orders""",
)
def _(spark, sf):
    return (
        dataset_info(table(spark, sf, "orders"), "orders")
        .withColumn("column_names", F.array_join("column_names", ","))
        .withColumn("dtypes", F.array_join("dtypes", ","))
    )


@query(
    "sample_page",
    f"SELECT {', '.join(ORDERS)}, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
)
def _(spark, sf):
    return sample_page(table(spark, sf, "orders"), ["o_orderkey"], limit=10, offset=20)


@query("dataset_head", f"SELECT {', '.join(LINEITEM)} FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5")
def _(spark, sf):
    """The first rows that go with a dataset's info."""
    return sample_page(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], limit=5).drop("total_rows")


# ---- rows behind a metric

_ALL = ", ".join(DIRTY)


@query(
    "rows_duplicate_all",
    V1 + f"""SELECT * FROM dirty_customer WHERE row_id IN (SELECT unnest(ids) FROM (
    SELECT list(row_id) AS ids FROM dirty_customer GROUP BY {_ALL} HAVING count(*) > 1))""",
)
def _(spark, sf):
    return drill.rows_duplicated(view(spark, sf, "dirty_customer"), exclude=["row_id"])


@query(
    "rows_duplicate_by_column",
    V1 + """SELECT * FROM dirty_customer WHERE coalesce(email, '~') IN (
    SELECT coalesce(email, '~') FROM dirty_customer GROUP BY email HAVING count(*) > 1)""",
)
def _(spark, sf):
    return drill.rows_duplicated(view(spark, sf, "dirty_customer"), "email")


@query("rows_missing_any", V1 + f"SELECT * FROM dirty_customer WHERE {' OR '.join(f'{c} IS NULL' for c in DIRTY)}")
def _(spark, sf):
    return drill.rows_missing(view(spark, sf, "dirty_customer"))


@query("rows_missing_column", V1 + "SELECT * FROM dirty_customer WHERE phone IS NULL")
def _(spark, sf):
    return drill.rows_missing(view(spark, sf, "dirty_customer"), "phone")


@query(
    "rows_outlier",
    V1 + f"SELECT d.* FROM dirty_customer d, ({fences('balance', 'dirty_customer')}) f WHERE balance < low OR balance > high",
)
def _(spark, sf):
    return drill.rows_outlying(view(spark, sf, "dirty_customer"), "balance")


@query(
    "rows_shown",
    V1 + """SELECT d.*, (SELECT count(*) FROM dirty_customer WHERE email IS NULL) AS offenders
    FROM dirty_customer d WHERE email IS NULL ORDER BY row_id LIMIT 100""",
)
def _(spark, sf):
    count, _text, shown = drill.explained(view(spark, sf, "dirty_customer"), "missing", "email", ["row_id"])
    return shown.withColumn("offenders", F.lit(count).cast("bigint"))


# ---- completeness


def _completeness(columns: list[str], source: str) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", {rnd(f'count({c}) * 100.0 / count(*)')} AS value, count({c}) AS numerator, "
        f"count(*) AS denominator FROM {source}"
        for c in columns
    )


@query(
    "completeness_overall",
    V1 + f"""SELECT 'Overall Completeness' AS name, {rnd('present * 100.0 / cells')} AS value, present AS numerator,
    cells AS denominator FROM (SELECT {big(' + '.join(f'count({c})' for c in DIRTY))} AS present,
    {big(f'count(*) * {len(DIRTY)}')} AS cells FROM dirty_customer)""",
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return whole(check(df, completeness.overall(shape)), "name", "value", "numerator", "denominator")


@query("completeness_by_column", V1 + _completeness(DIRTY, "dirty_customer"))
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return parts(check(df, completeness.by_column(shape)), "column", "value", "numerator", "denominator")


@query("completeness_lineitem", _completeness(LINEITEM, "lineitem"))
def _(spark, sf):
    df = nan_as_null(table(spark, sf, "lineitem"))
    return parts(check(df, completeness.by_column(Shape.of(df))), "column", "value", "numerator", "denominator")


_BLANKS = " + ".join(f"count(*) FILTER (regexp_full_match({c}, '\\s*'))" for c in TEXT)


@query(
    "empty_strings",
    V1 + f"""SELECT 'Empty String Rate' AS name, {rnd(f'100 - ({_BLANKS}) * 100.0 / (count(*) * {len(DIRTY)})')} AS value,
    {big(_BLANKS)} AS numerator, {big(f'count(*) * {len(DIRTY)}')} AS denominator FROM dirty_customer HAVING ({_BLANKS}) > 0""",
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return whole(check(df, completeness.blanks(shape)), "name", "value", "numerator", "denominator")


# ---- accuracy


@query(
    "type_consistency",
    with_views(["mixed_orders"])
    + """, kinds AS (
      SELECT 'payload' AS c, CASE json_type(payload) WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool'
        WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS k FROM mixed_orders WHERE payload IS NOT NULL
      UNION ALL SELECT 'note', 'str' FROM mixed_orders WHERE note <> 'null'),
    counted AS (SELECT c, k, count(*) AS n FROM kinds GROUP BY c, k),
    flagged AS (SELECT c, min_by(k, (-n, k)) AS expected, sum(n) - max(n) AS violations, sum(n) AS present FROM counted
      GROUP BY c HAVING count(*) > 1)
    SELECT c AS "column", expected, CAST(violations AS BIGINT) AS violations, CAST(present AS BIGINT) AS checked,
      CAST(NULL AS DOUBLE) AS score FROM flagged
    UNION ALL SELECT NULL, NULL, count(*), 3, round_even(100 - count(*) * 100.0 / 3, 2)::DOUBLE FROM flagged""",
)
def _(spark, sf):
    raw = view(spark, sf, "mixed_orders")
    df = raw.select("order_id", F.try_parse_json("payload").alias("payload"), F.try_parse_json("note").alias("note"))
    rows = check(df, accuracy.types(Shape.of(df)))
    return rows.select(
        "column", F.col("detail")["expected"].alias("expected"), F.col("numerator").alias("violations"),
        F.col("denominator").alias("checked"), F.col("value").alias("score"),
    )


def _outliers(columns: list[str], source: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", count(*) AS outliers,
        {rnd(f'count(*) * 100.0 / (SELECT count(*) FROM {source})')} AS percentage
        FROM {source}, ({fences(c, source)}) f WHERE {c} < low OR {c} > high HAVING count(*) > 0"""
        for c in columns
    )


def _outlier_parts(df: DataFrame, shape: Shape) -> DataFrame:
    rows = check(df, accuracy.outliers(shape, quartile_pairs(df, shape)))
    return parts(rows, "column", F.col("numerator").alias("outliers"), F.col("value").alias("percentage"))


@query("outliers_iqr", V1 + _outliers(["customer_id", "balance"], "dirty_customer"))
def _(spark, sf):
    return _outlier_parts(*dirty(spark, sf))


@query("outliers_iqr_lineitem", _outliers(NUMERIC_LINE, "lineitem"))
def _(spark, sf):
    df = nan_as_null(table(spark, sf, "lineitem"))
    return _outlier_parts(df, Shape.of(df))


@query(
    "format_validity",
    V1
    + union(
        f"""SELECT '{c}' AS "column", '{kind}' AS expected_format, count(*) AS violations,
        {rnd(f'count(*) * 100.0 / (SELECT count({c}) FROM dirty_customer)')} AS percentage
        FROM dirty_customer WHERE NOT regexp_matches({c}, '{FORMATS[kind]}') HAVING count(*) > 0"""
        for c, kind in (("email", "email"), ("phone", "phone"), ("zip_code", "zip"))
    ),
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return parts(
        check(df, accuracy.formats(shape)), "column", F.col("detail")["expected_format"].alias("expected_format"),
        F.col("numerator").alias("violations"), F.col("value").alias("percentage"),
    )


# ---- consistency


@query(
    "case_consistency",
    V1
    + "SELECT \"column\", CAST(NULL AS DOUBLE) AS score FROM ("
    + union(f"SELECT '{c}' AS \"column\", bool_or({mixed_case(c)}) AS hit FROM dirty_customer" for c in TEXT)
    + f") p WHERE hit UNION ALL SELECT NULL, value FROM ({DIRTY_METRICS}) WHERE name = 'Case Consistency'",
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return check(df, consistency.letter_case(shape)).select("column", F.col("value").alias("score"))


@query(
    "date_parse_rate",
    V1
    + union(
        f"""SELECT '{c}' AS "column", count(try_cast({c} AS TIMESTAMP)) AS parsed, count({c}) AS present,
        {rnd(f'count(try_cast({c} AS TIMESTAMP)) * 100.0 / count({c})')} AS value FROM dirty_customer"""
        for c in ("open_date", "close_date")
    ),
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return parts(
        check(df, consistency.date_parse(shape)), "column", F.col("numerator").alias("parsed"),
        F.col("denominator").alias("present"), "value",
    )


@query(
    "cross_field_dates",
    V1
    + f"""SELECT unnest([NULL, 'open_date > close_date']) AS fields, count(*) FILTER (crossed) AS violations,
    unnest([{rnd('(1 - count(*) FILTER (crossed) * 1.0 / count(*)) * 100')}, NULL]) AS score
    FROM (SELECT try_cast(open_date AS TIMESTAMP) > try_cast(close_date AS TIMESTAMP) AS crossed FROM dirty_customer)""",
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return check(df, consistency.date_order(shape)).select(
        F.col("column").alias("fields"), F.col("numerator").alias("violations"), F.col("value").alias("score")
    )


# ---- uniqueness, validity


def _row_uniqueness(columns: list[str], source: str) -> str:
    return f"""SELECT {rnd('distinct_rows * 100.0 / all_rows')} AS value, all_rows - distinct_rows AS duplicate_rows,
    all_rows AS total_rows FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {source}))
    AS distinct_rows, (SELECT count(*) FROM {source}) AS all_rows)"""


def _row_parts(df: DataFrame, shape: Shape) -> DataFrame:
    rows = uniqueness.row_uniqueness(df, shape)
    return rows.select("value", F.col("numerator").alias("duplicate_rows"), F.col("denominator").alias("total_rows"))


@query("row_uniqueness", V1 + _row_uniqueness(DIRTY, "dirty_customer"))
def _(spark, sf):
    return _row_parts(*dirty(spark, sf))


@query("row_uniqueness_lineitem", _row_uniqueness(LINEITEM, "lineitem"))
def _(spark, sf):
    df = nan_as_null(table(spark, sf, "lineitem"))
    return _row_parts(df, Shape.of(df))


def _column_uniqueness(columns: list[str], source: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", {rnd(f'count(DISTINCT {c}) * 100.0 / count({c})')} AS value,
        count(DISTINCT {c}) AS distinct_values, count({c}) AS present FROM {source}"""
        for c in columns
    )


def _distinct_parts(df: DataFrame, shape: Shape) -> DataFrame:
    return parts(
        uniqueness.column_uniqueness(df, shape), "column", "value", F.col("numerator").alias("distinct_values"),
        F.col("denominator").alias("present"),
    )


@query("column_uniqueness", V1 + _column_uniqueness(DIRTY, "dirty_customer"))
def _(spark, sf):
    return _distinct_parts(*dirty(spark, sf))


@query("column_uniqueness_lineitem", _column_uniqueness(LINEITEM, "lineitem"))
def _(spark, sf):
    df = nan_as_null(table(spark, sf, "lineitem"))
    return _distinct_parts(df, Shape.of(df))


@query(
    "negative_amounts",
    V1 + f"""SELECT count(*) FILTER (balance < 0) AS violations, count(*) AS checked,
    {rnd('(1 - count(*) FILTER (balance < 0) * 1.0 / count(*)) * 100')} AS score FROM dirty_customer""",
)
def _(spark, sf):
    df, shape = dirty(spark, sf)
    return whole(
        check(df, validity.negative_amounts(shape)), F.col("numerator").alias("violations"),
        F.col("denominator").alias("checked"), F.col("value").alias("score"),
    )


# ---- scores and rules

RULES = [
    ("r1", "Complete rows", "completeness", "overall completeness", None, 98.0, "critical", True, {"owner": "crm"}),
    ("r2", "Accurate", "accuracy", "overall accuracy", None, 90.0, "warning", True, {}),
    ("r3", "Close dates known", "completeness", "one column", "close_date", 90.0, "warning", True, {}),
    ("r4", "Ids unique", "uniqueness", "one column", "customer_id", 95.0, "info", True, {}),
    ("r5", "Fresh", "timeliness", "never measured", None, 50.0, "warning", True, {}),
    ("r6", "Off", "validity", "disabled", None, 100.0, "critical", False, {}),
    ("r7", "Unknown column", "completeness", "skipped", "no_such", 100.0, "critical", True, {}),
    ("r8", "Column of a metric without columns", "accuracy", "skipped", "email", 100.0, "critical", True, {}),
]
_RULE_ROWS = ", ".join(
    f"('{i}', '{n}', '{d}', {'NULL' if c is None else repr(c)}, CAST({t} AS DOUBLE), '{s}')"
    for i, n, d, _, c, t, s, on, _ in RULES
    if on
)
_SCORES = f"""metrics AS ({DIRTY_METRICS}),
scores AS (SELECT dimension, {rnd('avg(CAST(value AS DECIMAL(18, 2)))')} AS score FROM metrics GROUP BY dimension),
overall AS (SELECT {rnd(f'sum(score * {WEIGHT}) / sum({WEIGHT})')} AS overall_score FROM scores),
by_column AS (SELECT 'completeness' AS dimension, "column", value FROM ({_completeness(DIRTY, 'dirty_customer')})
  UNION ALL SELECT 'uniqueness', "column", value FROM ({_column_uniqueness(DIRTY, 'dirty_customer')})),
rules(rule_id, name, dimension, "column", threshold, severity) AS (VALUES {_RULE_ROWS}),
judged AS (
  SELECT r.*, coalesce(s.score, 0) AS score FROM rules r LEFT JOIN scores s USING (dimension) WHERE r."column" IS NULL
  UNION ALL SELECT r.*, b.value FROM rules r JOIN by_column b ON r.dimension = b.dimension AND r."column" = b."column")
"""
SCORED = V1 + ", " + _SCORES


def dirty_assessment(spark: SparkSession, sf: str) -> Assessment:
    df = view(spark, sf, "dirty_customer")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return assess(df, "customers", AS_OF, rules=rules, exclude=["row_id"])


@query("assess_quality", SCORED + "SELECT dimension, name, value FROM metrics")
def _(spark, sf):
    return whole(dirty_assessment(spark, sf).metrics, "dimension", "name", "value")


@query(
    "assess_orders",
    table_metrics(
        "orders", ORDERS, ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"], [],
        ["o_orderdate"], [], ["o_totalprice"],
    ),
)
def _(spark, sf):
    return whole(assess(table(spark, sf, "orders"), "orders", AS_OF).metrics, "dimension", "name", "value")


@query("dimension_scores", SCORED + "SELECT dimension, score FROM scores")
def _(spark, sf):
    return dirty_assessment(spark, sf).dimension_scores


@query("overall_score", SCORED + "SELECT overall_score FROM overall")
def _(spark, sf):
    return scoring.overall_score(dirty_assessment(spark, sf).dimension_scores)


@query(
    "apply_rules",
    SCORED + """SELECT count(*) FILTER (score >= threshold) AS passed_rules, count(*) FILTER (score < threshold)
    AS failed_rules, count(*) FILTER (score < threshold AND severity = 'warning') AS warnings FROM judged""",
)
def _(spark, sf):
    return dirty_assessment(spark, sf).verdicts


@query(
    "rule_alerts",
    SCORED + """SELECT sha256('customers|2024-01-31 00:00:00|' || rule_id) AS alert_id, severity, rule_id,
    name AS rule_name, dimension, name || ' failed: Score ' || score::VARCHAR || '% below threshold '
    || threshold::VARCHAR || '%' AS message, 'customers' AS dataset_id, score AS metric_value, threshold
    FROM judged WHERE score < threshold""",
)
def _(spark, sf):
    return dirty_assessment(spark, sf).alerts.drop("ts", "details")


@query(
    "score_bands",
    SCORED + """SELECT dimension, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good'
    WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS band FROM scores""",
)
def _(spark, sf):
    return dirty_assessment(spark, sf).dimension_scores.withColumn("band", scoring.score_band(F.col("score")))


_ORDINAL = f"list_position({DIRTY!r}, \"column\")"


def _uniqueness_parts(spark: SparkSession, sf: str) -> DataFrame:
    df, shape = dirty(spark, sf)
    rows = scoring.columns_of(uniqueness.column_uniqueness(df, shape), uniqueness.BY_COLUMN)
    return scoring.with_ordinal(rows, shape.names).select("column", "value", "ordinal")


@query(
    "worst_column",
    V1 + f"""SELECT "column", value FROM ({_column_uniqueness(DIRTY, 'dirty_customer')}) ORDER BY value, {_ORDINAL} LIMIT 1""",
)
def _(spark, sf):
    return scoring.worst_column(_uniqueness_parts(spark, sf))


@query(
    "lowest_columns",
    f"""SELECT "column", value FROM ({_column_uniqueness(LINEITEM, 'lineitem')})
    ORDER BY value, list_position({LINEITEM!r}, "column") LIMIT 10""",
)
def _(spark, sf):
    df = nan_as_null(table(spark, sf, "lineitem"))
    shape = Shape.of(df)
    rows = scoring.columns_of(uniqueness.column_uniqueness(df, shape), uniqueness.BY_COLUMN)
    return scoring.lowest_columns(scoring.with_ordinal(rows, shape.names)).select("column", "value")


# fixed values: the segments of customers
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_REST, _REST_TEXT = ([c for c in names if c != "status"] for names in (DIRTY, TEXT))


def _segment(segment: str) -> str:
    """All metrics of the customers of one segment."""
    found = table_metrics(
        f"of_{segment}", _REST, _REST_TEXT, ["customer_id", "balance"],
        [("email", "email"), ("phone", "phone"), ("zip_code", "zip")],
        ["open_date", "close_date"], [("open_date", "close_date")], ["balance"],
    )
    return f"SELECT '{segment}' AS status, dimension, name, value FROM ({found}) WHERE EXISTS (FROM of_{segment})"


@query(
    "assess_groups",
    with_views(["dirty_customer"], *[f"of_{s} AS (SELECT * FROM dirty_customer WHERE status = '{s}')" for s in SEGMENTS])
    + union(_segment(s) for s in SEGMENTS),
)
def _(spark, sf):
    """Every check, outliers and uniqueness included, within each segment of customers."""
    rows = assess_groups(view(spark, sf, "dirty_customer"), ["status"], ["row_id"])
    return whole(rows, "status", "dimension", "name", "value")


@query(
    "outliers_by_group",
    V1
    + union(
        f"""SELECT status, '{c}' AS "column", count(*) AS outliers, CAST(any_value(q1) AS DOUBLE) AS q1,
        CAST(any_value(q3) AS DOUBLE) AS q3 FROM dirty_customer JOIN (SELECT status, quantile_cont({c}, 0.25) AS q1,
        quantile_cont({c}, 0.75) AS q3 FROM dirty_customer GROUP BY status) USING (status)
        WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) GROUP BY status"""
        for c in ("customer_id", "balance")
    ),
)
def _(spark, sf):
    """Outliers within each segment of customers, with the quartiles of the segment."""
    rows = assess_groups(view(spark, sf, "dirty_customer"), ["status"], ["row_id"])
    rows = rows.where((F.col("name") == accuracy.RANGE) & F.col("column").isNotNull())
    ends = [F.col("detail")[q].cast("double").alias(q) for q in ("q1", "q3")]
    return rows.select("status", "column", F.col("numerator").alias("outliers"), *ends)

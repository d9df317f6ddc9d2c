"""Hand-made tables with known metrics."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, nan_as_null
from plumbline.operators import accuracy, completeness, consistency, drill, scoring
from plumbline.operators.check import run_checks
from plumbline.operators.profile import duplicate_profile, profile
from plumbline.operators.rules import RULE_SCHEMA
from plumbline.plans.assess import assess, assess_groups

AS_OF = datetime(2024, 3, 1)


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def values(assessment):
    rows = assessment.metrics.where(F.col("column").isNull()).collect()
    return {r["name"]: r["value"] for r in rows}


def dimensions(assessment):
    return {r["dimension"]: r["score"] for r in assessment.dimension_scores.collect()}


def test_ten_rows(spark):
    rows = [
        (None if i == 3 else float(i + 1), "Person " + "ABCDEFGHIJ"[i] if i != 8 else "Person H",
         None if i == 5 else f"p{i}@mail.com", -100 if i == 2 else i * 100, "2024-01-01")
        for i in range(10)
    ]
    df = table(spark, "customer_id double, name string, email string, balance bigint, created_date string", rows)
    found = assess(df, "t", AS_OF)
    assert values(found) == {
        "Overall Completeness": 96.0, "Column Completeness": 96.0, "Data Type Consistency": 100.0,
        "Numeric Range Accuracy": 100.0, "Format Accuracy": 100.0, "Case Consistency": 100.0,
        "Date Format Consistency": 100.0, "Cross-Field Consistency": 100.0, "Row Uniqueness": 100.0,
        "Column Uniqueness": 80.0, "Business Rule Validity": 90.0,
    }
    assert dimensions(found) == {"completeness": 96.0, "accuracy": 100.0, "consistency": 100.0, "uniqueness": 90.0, "validity": 90.0}
    score = found.score.first()
    assert score["overall_score"] == 96.0 and score["total_records"] == 10 and score["passed_rules"] == 0


def test_empty_table(spark):
    found = assess(table(spark, "a string, amount double, b int", []), "t", AS_OF)
    assert dimensions(found) == {"completeness": 0.0, "accuracy": 100.0, "consistency": 100.0, "uniqueness": 50.0, "validity": 100.0}
    assert found.score.first()["overall_score"] == 67.5
    assert "Format Accuracy" not in values(found)


def test_nulls_and_nan(spark):
    df = table(spark, "x double, y float, s string", [(float("nan"), 1.0, None), (None, float("nan"), None), (2.0, 3.0, None)])
    found = assess(df, "t", AS_OF)
    assert values(found)["Overall Completeness"] == 33.33
    parts = {(r["name"], r["column"]): r["value"] for r in found.metrics.where("column is not null").collect()}
    assert parts["Column Completeness", "s"] == 0.0 and parts["Column Uniqueness", "s"] == 0.0
    assert parts["Column Completeness", "x"] == 33.33
    assert drill.rows_missing(df, "y").count() == 1 and drill.rows_missing(df).count() == 3


def test_scores_may_fall_below_zero(spark):
    rows = [(a, b, c, "2024-02-01", "2024-01-01", "2024-02-01", "2024-01-01", "2024-02-01", "2024-01-01")
            for a, b, c in [(0, 0, 0)] * 3 + [(9, 9, 9)]]
    schema = ("a int, b int, c int, start_date string, end_date string, created_at string, updated_at string, "
              "open_date string, close_date string")
    found = values(assess(table(spark, schema, rows), "t", AS_OF))
    assert found["Cross-Field Consistency"] == -200.0
    # quartiles 0 and 2.25, so 9 lies outside in each of the three columns
    assert found["Numeric Range Accuracy"] == 25.0


def test_outliers_of_all_columns_below_zero(spark):
    rows = [(float(i == 0), float(i == 0), float(i == 0), float(i == 0), float(i == 0)) for i in range(4)] * 1 + [(0.0,) * 5] * 1
    found = values(assess(table(spark, "a double, b double, c double, d double, e double", rows), "t", AS_OF))
    assert found["Numeric Range Accuracy"] == 0.0
    more = [(float(i == 0),) * 6 for i in range(5)]
    found = values(assess(table(spark, "a double, b double, c double, d double, e double, f double", more), "t", AS_OF))
    assert found["Numeric Range Accuracy"] == -20.0


def test_formats_by_name(spark):
    df = table(
        spark, "email_or_phone string, phone bigint, ZIP string",
        [("a@b.co", 1, "12345"), ("+15551234567", 2, "1234"), (None, 3, "12345-6789"), ("x", 4, None)],
    )
    rows = run_checks(df, [accuracy.formats(Shape.of(df))]).collect()
    whole = next(r for r in rows if r["column"] is None)
    assert (whole["numerator"], whole["denominator"], whole["value"]) == (5, 9, 44.44)
    parts = {(r["column"], r["detail"]["expected_format"]): r["numerator"] for r in rows if r["column"]}
    assert parts == {("email_or_phone", "email"): 2, ("email_or_phone", "phone"): 2, ("ZIP", "zip"): 1}


def test_negative_amounts_count_text_columns(spark):
    df = table(spark, "amount int, price_text string, total_cost decimal(8,2)", [(-1, "-5", Decimal("-1.50")), (2, "x", Decimal("1"))])
    assert values(assess(df, "t", AS_OF))["Business Rule Validity"] == 66.67


def test_variant_classes(spark):
    texts = ["1", "2.5", '"x"', "true", "null", "[1]", '{"a": 1}', "1e3", '"y"', None]
    df = table(spark, "t string, k int", [(t, 1) for t in texts]).select(F.parse_json("t").alias("v"), "k")
    rows = run_checks(df, [accuracy.types(Shape.of(df))]).collect()
    part = next(r for r in rows if r["column"] == "v")
    assert (part["detail"]["expected"], part["numerator"], part["denominator"]) == ("float", 6, 8)
    assert next(r for r in rows if r["column"] is None)["value"] == 50.0


def test_odd_column_names(spark):
    df = table(spark, "`a.b` int, `it's` string, `back``tick` double, `q\"uote` string", [(1, "x", 1.0, "y"), (1, "x", 1.0, "y"), (2, None, None, "\\")])
    found = values(assess(df, "t", AS_OF))
    assert found["Row Uniqueness"] == 66.67 and found["Overall Completeness"] == 83.33
    assert drill.rows_duplicated(df).count() == 2
    assert profile(df).count() == 4


def test_wide_table_in_batches(spark, monkeypatch):
    from plumbline.operators import check

    df = spark.range(20).selectExpr("id % 2 AS g", *[f"if(id % {i + 2} = 0, null, id) AS c{i}" for i in range(30)])
    def rows(*keys):
        shape = Shape.of(df, list(keys))
        found = run_checks(df, [completeness.overall(shape), completeness.by_column(shape)], list(keys))
        return sorted(map(str, found.collect()))
    whole, grouped = rows(), rows("g")
    monkeypatch.setattr(check, "MAX_MEASURES", 7)
    assert rows() == whole and rows("g") == grouped


def test_booleans_and_other_types(spark):
    df = spark.range(6).selectExpr(
        "id % 2 = 0 as flag", "array(id % 2) as items", "date'2024-01-01' + cast(id % 3 as int) as updated", "binary('x') as raw",
        "named_struct('a', id) as nested", "cast(id as decimal(5,1)) as dec",
    )
    rows = {r["column"]: r for r in profile(df).collect()}
    assert rows["flag"]["unique_count"] == 2 and rows["flag"]["mean"] is None and rows["flag"]["mode"] is None
    assert rows["items"]["unique_count"] == 2 and rows["updated"]["unique_count"] == 3
    assert rows["dec"]["median"] == 2.5 and rows["nested"]["unique_count"] == 6 and rows["raw"]["unique_count"] == 1
    assert values(assess(df.drop("items", "nested"), "t", AS_OF))["Date Format Consistency"] == 100.0


def test_null_bearing_duplicates(spark):
    df = table(spark, "a string, b int, c int", [("x", 1, 1), ("x", 1, 1), ("y", None, 1), ("y", None, 1), ("z", 3, 1)])
    assert values(assess(df, "t", AS_OF))["Row Uniqueness"] == 60.0
    assert drill.rows_duplicated(df).count() == 4
    row = duplicate_profile(df).first()
    assert (row["duplicate_count"], row["duplicate_percentage"]) == (1, 20.0)
    assert drill.rows_duplicated(df, "b").count() == 4


def test_profile_of_hundred_rows(spark):
    df = spark.range(100).selectExpr("id", "id * 10 as value", "if(id < 50, 'A', 'B') as category", "concat('Item ', id) as description")
    rows = {r["column"]: r for r in profile(df).collect()}
    v = rows["value"]
    assert [v[k] for k in ("mean", "median", "min", "max", "q25", "q75")] == [495.0, 495.0, 0.0, 990.0, 247.5, 742.5]
    assert v["std"] == pytest.approx(290.1149, abs=1e-4)
    c = rows["category"]
    assert (c["unique_count"], c["unique_percentage"], c["mode"]) == (2, 2.0, "A")
    assert [(t["value"], t["n"]) for t in c["top_values"]] == [("A", 50), ("B", 50)]
    assert (rows["description"]["min_length"], rows["description"]["max_length"]) == (6, 7)
    assert [r["column"] for r in profile(df).collect()] == ["id", "value", "category", "description"]


def test_drill_explanations(spark):
    df = table(spark, "id int, v double, s string", [(i, 1000.0 if i == 0 else float(i % 5), None if i < 150 else "x") for i in range(300)])
    count, text, shown = drill.explained(df, "missing", "s", ["id"])
    assert (count, text, shown.count()) == (150, "Found 150 records with missing values in 's'", 100)
    assert [r["id"] for r in shown.take(3)] == [0, 1, 2]
    assert drill.explained(df, "outliers", "v", ["id"])[:2] == (1, "Found 1 outlier records in 'v'")
    count, text, shown = drill.explained(df, "outliers", "s", ["id"])
    assert (count, text, shown.count()) == (0, "No numeric column specified for outlier detection", 0)
    assert drill.explained(df, "duplicates", "s", ["id"])[:2] == (300, "Found 300 duplicate records in column 's'")


RULES = [
    ("a", "All there", "completeness", "", None, 99.0, "critical", True, {"k": "v"}),
    ("b", "S there", "completeness", "", "s", 10.0, "warning", True, {}),
    ("c", "S differs", "uniqueness", "", "s", 90.0, "warning", True, {}),
    ("d", "Fresh", "timeliness", "", None, 0.0, "info", True, {}),
    ("e", "Fresher", "timeliness", "", None, 1.0, "info", True, {}),
    ("f", "Nowhere", "completeness", "", "nope", 100.0, "critical", True, {}),
    ("g", "Off", "completeness", "", None, 100.0, "critical", False, {}),
    ("h", "No columns there", "validity", "", "s", 100.0, "critical", True, {}),
]


def test_rules_and_alerts(spark):
    df = table(spark, "s string, n int", [("x", 1), ("x", 2), (None, 3), ("y", 4)])
    found = assess(df, "data", AS_OF, "Data", table(spark, RULE_SCHEMA, RULES))
    assert tuple(found.verdicts.first()) == (2, 3, 1)
    alerts = {r["rule_id"]: r for r in found.alerts.collect()}
    assert set(alerts) == {"a", "c", "e"}
    assert alerts["a"]["message"] == "All there failed: Score 87.5% below threshold 99.0%"
    assert alerts["a"]["details"] == {"k": "v"} and alerts["c"]["metric_value"] == 66.67 and alerts["e"]["metric_value"] == 0.0
    again = assess(df, "data", AS_OF, "Data", table(spark, RULE_SCHEMA, RULES))
    assert {r["alert_id"] for r in again.alerts.collect()} == {r["alert_id"] for r in alerts.values()}


def test_bands_and_columns(spark):
    df = spark.createDataFrame([(90.0,), (89.99,), (70.0,), (50.0,), (49.9,), (-3.0,)], "v double")
    assert [r[0] for r in df.select(scoring.score_band(F.col("v"))).collect()] == ["Excellent", "Good", "Good", "Fair", "Poor", "Poor"]
    parts = spark.createDataFrame([("a", 50.0, 0), ("b", 10.0, 1), ("c", 10.0, 2)], "column string, value double, ordinal int")
    assert tuple(scoring.worst_column(parts).first()) == ("b", 10.0)
    assert [r["column"] for r in scoring.lowest_columns(parts, k=2).collect()] == ["b", "c"]
    other = spark.createDataFrame([("timeliness", 50.0), ("validity", 100.0)], "dimension string, score double")
    assert scoring.overall_score(other).first()[0] == 80.0
    with pytest.raises(ValueError):
        scoring.columns_of(parts, "Row Uniqueness")


def test_groups_equal_single_assessments(spark):
    df = table(spark, "g string, email string, amount double, n int", [("a", "x@y.zz", -1.0, None), ("a", " ", 2.0, 1), ("b", None, 3.0, 1), ("b", "Bad mAil", 4.0, None)])
    grouped = scoring.dimension_scores(assess_groups(df, ["g"]), ["g"]).collect()
    for g in ("a", "b"):
        single = dimensions(assess(df.where(F.col("g") == g).drop("g"), "t", AS_OF))
        for row in grouped:
            if row["g"] == g and row["dimension"] in ("completeness", "consistency", "validity"):
                assert row["score"] == single[row["dimension"]]


def test_dates_parse_one_by_one(spark):
    df = table(spark, "event_date string, updated timestamp, time_zone int", [("2024-01-05", AS_OF, 1), ("never", None, 2), (None, AS_OF, 3)])
    rows = {r["column"]: r for r in run_checks(nan_as_null(df), [consistency.date_parse(Shape.of(df))]).collect()}
    assert (rows["event_date"]["numerator"], rows["event_date"]["denominator"], rows["event_date"]["value"]) == (1, 2, 50.0)
    assert rows["updated"]["value"] == 100.0


def test_unknown_kind_has_no_rows(spark):
    from plumbline.operators import drill

    df = spark.createDataFrame([(1, 1.0), (2, 900.0)], "id int, v double")
    count, text, shown = drill.explained(df, "typo", "v", ["id"])
    assert (count, shown.count()) == (0, 0) and "typo" in text

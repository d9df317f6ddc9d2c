from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.operators import alerts as al
from plumbline.operators import history as hi
from plumbline.plans.assess import assess
from plumbline.plans.report import quality_report
from plumbline.operators.rules import RULE_SCHEMA
from plumbline.sources import writers
from plumbline.sources.readers import read_acknowledgements, read_stored, stored_datasets

NOW = datetime(2024, 5, 10)
SCORES = "dataset_id string, dataset_name string, ts timestamp, overall_score double, total_records bigint, passed_rules int, failed_rules int, warnings int, dimension_scores string"
ALERTS = "alert_id string, ts timestamp, severity string, rule_id string, rule_name string, dimension string, message string, dataset_id string, metric_value double, threshold double, details map<string,string>"


def days(n):
    return NOW - timedelta(days=n)


def scores(spark, points):
    return spark.createDataFrame([(d, d.upper(), days(n), s, 10, 1, 0, 0, '{"accuracy":%s}' % s) for d, n, s in points], SCORES)


def test_trends(spark):
    df = scores(spark, [("up", 6, 80.0), ("up", 1, 85.01), ("flat", 6, 80.0), ("flat", 1, 85.0), ("down", 5, 80.0), ("down", 3, 99.0), ("down", 0, 74.99), ("one", 2, 60.0), ("one", 40, 10.0), ("old", 30, 50.0)])
    rows = {r["dataset_id"]: tuple(r)[1:] for r in hi.score_trend(df, 7, NOW).collect()}
    assert rows == {
        "up": ("improving", 5.01, 85.01, 80.0, 2), "flat": ("stable", 5.0, 85.0, 80.0, 2), "down": ("degrading", -5.01, 74.99, 80.0, 3),
        "one": ("insufficient_data", 0.0, 60.0, 0.0, 1), "old": ("insufficient_data", 0.0, 0.0, 0.0, 0),
    }
    history = hi.score_history(df, 30, NOW, "one").collect()
    assert [(r["overall_score"], r["dimension_scores"]) for r in history] == [(60.0, {"accuracy": 60.0})]
    assert [r["overall_score"] for r in hi.score_history(df, 30, NOW, "old").collect()] == [50.0]
    dims = df.select("dataset_id", "ts", F.lit("accuracy").alias("dimension"), F.col("overall_score").alias("score"))
    trends = {r["dataset_id"]: (r["change"], r["current"], r["trend"]) for r in hi.dimension_trends(dims, 7, NOW).collect()}
    assert trends == {"up": (5.01, 85.01, "improving"), "flat": (5.0, 85.0, "improving"), "down": (-5.01, 74.99, "degrading")}
    assert [r["score"] for r in hi.dimension_trend(dims, "accuracy", 7, NOW, "down").collect()] == [80.0, 99.0, 74.99]
    stats = {r["dataset_id"]: r for r in hi.score_statistics(df).collect()}
    assert tuple(stats["down"])[1:] == (74.99, NOW, 10, 84.66, 74.99, 99.0, 3)
    assert hi.score_statistics(df.limit(0)).count() == 0
    assert [r["dataset_id"] for r in hi.monitored_datasets(df).collect()][:2] == ["down", "flat"]


def alerts(spark, specs):
    return spark.createDataFrame([(str(i), days(n), sev, "r", "R", dim, "m", ds, 1.0, 2.0, {}) for i, (n, sev, dim, ds) in enumerate(specs)], ALERTS)


def test_alert_states(spark):
    df = alerts(spark, [(0, "critical", "accuracy", "a"), (1, "warning", "accuracy", "a"), (40, "warning", "validity", "b"), (41, "info", "validity", "b")])
    none = spark.createDataFrame([], "alert_id string, ts timestamp")
    acks = spark.createDataFrame([("1", NOW), ("2", NOW), ("2", NOW), ("99", NOW)], "alert_id string, ts timestamp")
    assert [r["alert_id"] for r in al.active_alerts(df, acks).collect()] == ["0", "3"]
    assert [r["alert_id"] for r in al.active_alerts(df, none, "warning").collect()] == ["1", "2"]
    assert [r["alert_id"] for r in al.active_alerts(df, none, dataset_id="b").collect()] == ["2", "3"]
    summary = al.alert_summary(df, acks).first()
    assert tuple(summary) == (2, 1, 0, 1, {"accuracy": 1, "validity": 1}, days(41), NOW)
    empty = al.alert_summary(df.limit(0), none).first()
    assert empty["total_active"] == 0 and empty["by_dimension"] == {} and empty["oldest_alert"] is None
    assert sorted(r["alert_id"] for r in al.retained_alerts(df, acks, 30, NOW).collect()) == ["0", "1", "3"]
    assert al.cleared_count(df, acks, 30, NOW).first()[0] == 1
    assert al.with_state(df, acks).count() == 4
    assert al.acknowledgement(df, "3", NOW).count() == 1 and al.acknowledgement(df, "x", NOW).count() == 0


def trend(spark, counts):
    df = alerts(spark, [(n, "info", "accuracy", "a") for n, k in counts.items() for _ in range(k)])
    row = al.alert_trend(df, 7, NOW).first()
    return row["total_alerts"], row["days_with_alerts"], row["trend"]


def test_alert_trend(spark):
    assert trend(spark, {9: 5}) == (0, 0, "stable")
    assert trend(spark, {1: 5}) == (5, 1, "stable")
    assert trend(spark, {1: 5, 3: 1}) == (6, 2, "decreasing")  # both windows are the same two days
    assert trend(spark, {5: 1, 4: 2, 3: 3, 1: 2}) == (8, 4, "increasing")
    assert trend(spark, {6: 4, 5: 1, 4: 2, 3: 3, 1: 1}) == (11, 5, "decreasing")
    daily = al.alert_daily(alerts(spark, [(1, "info", "x", "a"), (1, "critical", "x", "a"), (3, "info", "x", "a")]), 7, NOW).collect()
    assert sorted((r["total"], r["critical"], r["warning"], r["info"]) for r in daily) == [(1, 0, 0, 1), (2, 1, 0, 1)]


def test_recommendations(spark):
    dims = ["completeness", "accuracy", "consistency", "uniqueness", "validity"]
    bad = spark.createDataFrame([("bad", d, 10.0) for d in dims] + [("fine", d, 95.0) for d in dims] + [("mid", "uniqueness", 94.9), ("mid", "completeness", 79.9)], "dataset_id string, dimension string, score double")
    df = alerts(spark, [(0, "critical", "accuracy", "mid"), (1, "critical", "accuracy", "mid"), (1, "critical", "accuracy", "unknown")])
    rows = al.recommendations(bad, df).orderBy("dataset_id", "position").collect()
    texts = {}
    for r in rows:
        texts.setdefault(r["dataset_id"], []).append(r["recommendation"])
    assert set(texts) == {"bad", "mid"} and len(texts["bad"]) == 10
    assert texts["bad"][:4] == [*al.ADVICE["completeness"], al.ADVICE["accuracy"][0]]
    assert texts["mid"] == ["Address 2 critical issues immediately to prevent data quality degradation", al.UNIQUENESS_ADVICE[1], al.COMPLETENESS_ADVICE[1]]


def test_stored_and_reported(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, None, -5.0)], "id int, name string, amount double")
    rules = spark.createDataFrame([("r", "Full", "completeness", "", None, 99.0, "critical", True, {})], RULE_SCHEMA)
    for n, data in enumerate((df, df.where("id < 3"))):
        writers.record(assess(data, "d", days(1 - n), "D", rules, exclude=["id"]), str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/scores")
    dims = spark.read.parquet(f"{tmp_path}/dimension_scores")
    raised = spark.read.parquet(f"{tmp_path}/alerts")
    assert stored.count() == 2 and dims.count() == 10 and raised.count() == 1
    # recorded again, as after a failure, nothing is there twice
    writers.record(assess(df, "d", days(1), "D", rules, exclude=["id"]), str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("scores", "dimension_scores", "alerts")] == [2, 10, 1]
    stored, dims, raised = (read_stored(spark, str(tmp_path), n) for n in ("scores", "dimension_scores", "alerts"))
    # a window opens the folders of its days only
    recent = read_stored(spark, str(tmp_path), "scores", since=days(0), dataset_id="d")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert recent.count() == 1 and "day" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    trend = {r["dataset_id"]: r["data_points"] for r in hi.score_trend(recent, 30, NOW, stored_datasets(spark, str(tmp_path))).collect()}
    assert trend == {"d": 1}
    late = read_stored(spark, str(tmp_path), "scores", since=NOW + timedelta(days=99))
    assert [r["trend"] for r in hi.score_trend(late, 7, NOW, stored_datasets(spark, str(tmp_path))).collect()] == ["insufficient_data"]
    alert_id = raised.first()["alert_id"]
    assert writers.acknowledge(raised, alert_id, NOW, str(tmp_path))
    assert not writers.acknowledge(raised, "no such", NOW, str(tmp_path))
    assert writers.acknowledge(raised, alert_id, NOW, str(tmp_path))
    acks = read_acknowledgements(spark, str(tmp_path))
    assert acks.count() == 1
    assert al.active_alerts(raised, acks).count() == 0
    report = quality_report(df, "d", NOW, raised, acks, stored, dims, row_id="id")
    writers.write_report(report, f"{tmp_path}/report")
    row = spark.read.json(f"{tmp_path}/report/document").first()
    twins = spark.read.json(f"{tmp_path}/report/duplicates").orderBy("id").collect()
    assert [(r["id"], r["group_id"], r["name"]) for r in twins] == [(1, "1", "a"), (2, "1", "a")]
    assert row["quality_score"]["total_records"] == 3 and len(row["profile"]) == 2
    assert row["duplicate_totals"]["groups"] == 1 and row["duplicate_totals"]["records"] == 2
    assert row["trend"]["trend"] in ("improving", "stable") and len(row["dimension_trends"]) == 5
    assert [a["alert_id"] for a in row["alerts"]] == [alert_id]
    assert "Address 1 critical issues immediately to prevent data quality degradation" in row["recommendations"]

import json

import pytest

from plumbline.functions.columns import Shape
from plumbline.operators.accuracy import types
from plumbline.operators.check import run_checks
from plumbline.sources.readers import PageIndex, dataset_info, read_csv, read_json, read_table, sample_page


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "whole,gaps,num,flag,flag_gap,day,empty,text,big,quoted,blank\n"
        '1,1,1.5,True,True,2024-01-15,,x,9223372036854775808,"a ""b"", c",\n'
        '2,NA,-2e3,False,,2024-01-16,NaN,7,1,"",  \n'
        '-3,3,.5,True,False,2024-01-17,null,N/A,2,"two\nlines",z\n'
    )
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {
        "whole": "bigint", "gaps": "double", "num": "double", "flag": "boolean", "flag_gap": "string", "day": "string",
        "empty": "double", "text": "string", "big": "double", "quoted": "string", "blank": "string",
    }
    rows = df.orderBy("whole").collect()
    assert [r["whole"] for r in rows] == [-3, 1, 2] and [r["gaps"] for r in rows] == [3.0, 1.0, None]
    assert [r["text"] for r in rows] == [None, "x", "7"] and rows[0]["quoted"] == "two\nlines"
    assert rows[1]["quoted"] == 'a "b", c' and rows[2]["quoted"] is None
    assert [r["blank"] for r in rows] == ["z", None, "  "] and rows[1]["num"] == 1.5 and rows[1]["flag"] is True


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_json_records(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1, "v": 1}, {"id": 2, "v": "x"}, {"id": 3, "v": None}, {"id": 4, "v": 2.5}]))
    df = read_json(spark, str(tmp_path / "t.json"), mixed=["v"])
    assert dict(df.dtypes) == {"id": "bigint", "v": "variant"} and df.count() == 4
    part = run_checks(df, [types(Shape.of(df))]).where("column = 'v'").first()
    assert (part["detail"]["expected"], part["numerator"]) == ("float", 2)
    assert df.where("v IS NULL").count() == 1
    # found by itself, and read as text if told so
    assert dict(read_json(spark, str(tmp_path / "t.json")).dtypes)["v"] == "variant"
    assert dict(read_json(spark, str(tmp_path / "t.json"), mixed=[]).dtypes)["v"] == "string"


def test_json_lines_and_dates(spark, tmp_path):
    rows = [{"id": 1, "date": "2024-01-05", "seen_at": "2024-01-05 10:00:00", "end_time": "soon"}, {"id": 2, "date": None, "seen_at": "2024-02-01", "end_time": "2024-01-01"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    df = read_json(spark, str(tmp_path / "t.jsonl"), lines=True)
    assert dict(df.dtypes) == {"id": "bigint", "date": "timestamp", "seen_at": "timestamp", "end_time": "string"} and df.count() == 2


def test_table_info_and_pages(spark, tmp_path):
    spark.range(250).selectExpr("id", "id % 7 as k").write.parquet(f"{tmp_path}/t")
    df = read_table(spark, f"{tmp_path}/t")
    info = dataset_info(df, "t").first()
    assert (info["rows"], info["columns"], info["column_names"], info["dtypes"]) == (250, 2, ["id", "k"], ["bigint", "bigint"])
    assert [r["id"] for r in sample_page(df, ["id"], 3, 100).collect()] == [100, 101, 102]
    assert sample_page(df, ["id"], 10, 245).count() == 5 and sample_page(df, ["id"]).count() == 10
    assert {r["total_rows"] for r in sample_page(df, ["id"], 3, 100).collect()} == {250}
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            sample_page(df, ["id"], **bad)


def test_surplus_fields_are_an_error(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="1 rows"):
        read_csv(spark, str(path))
    path.write_text("a,b\n1,2\n3,4\n6\n")
    assert [tuple(r) for r in read_csv(spark, str(path)).orderBy("a").collect()] == [(1, 2.0), (3, 4.0), (6, None)]


def test_pages_by_position(spark, tmp_path):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 AS `row id`", "id % 3 AS k", "id").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = PageIndex.of(rows, ["k", "row id"], f"{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((r["k"], r["row id"]) for r in rows.collect())
    assert index.total == 1000 and len(index.ranges) > 1
    edge = index.ranges[1][1]  # where the second range starts
    for offset, limit in ((0, 10), (edge - 3, 7), (edge, 1), (995, 100), (1000, 5), (5000, 5)):
        got = [(r["k"], r["row id"], r["total_rows"]) for r in index.page(limit, offset).collect()]
        assert got == [(*w, 1000) for w in want[offset : offset + limit]]
    plan = index.page(5, 900)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__range" in plan.split("PartitionFilters")[1][:200] and "TakeOrdered" not in plan
    assert len(index.page(5, 900).inputFiles()) <= 8
    with pytest.raises(ValueError):
        index.page(0, 0)
    empty = PageIndex.of(rows.limit(0), ["k"], f"{tmp_path}/empty")
    assert empty.total == 0 and empty.page(5).count() == 0

"""Queries over files written from the given tables: the typing of CSV and JSON sources."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape
from plumbline.functions.text import FORMATS
from plumbline.operators import accuracy, completeness, consistency
from plumbline.operators.check import run_checks
from plumbline.session import shared_folder
from plumbline.sources.readers import read_csv, read_json
from workload.sql import DIRTY, collection, with_views
from workload.views import table, view

QUERIES, ORACLES, query = collection()


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_source", with_views(["dirty_customer"]) + f"SELECT row_id, {', '.join(DIRTY)} FROM dirty_customer")
def _(spark, sf):
    """The dirty customers through a CSV file: types are found again, dates stay text, blanks stay blank."""
    path = _scratch(spark, "csv")
    rows = view(spark, sf, "dirty_customer")
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    ).csv(path)
    return read_csv(spark, path)


@query(
    "json_source",
    """SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, lang, source, text FROM documents""",
)
def _(spark, sf):
    """Documents through JSON lines, whole texts with all their characters."""
    path = _scratch(spark, "json")
    table(spark, sf, "documents").write.json(path)
    return read_json(spark, path, lines=True).select("doc_id", "n_chars", "lang", "source", "text")


@query(
    "json_mixed_types",
    """SELECT 'value' AS "column", CASE WHEN count(*) FILTER (k = 'str') > count(*) FILTER (k = 'int') THEN 'str' ELSE 'int' END
    AS expected, least(count(*) FILTER (k = 'str'), count(*) FILTER (k = 'int')) AS violations, count(*) AS checked
    FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'str' ELSE 'int' END AS k FROM events)""",
)
def _(spark, sf):
    """Events through JSON lines whose value is a number or a text, read without losing which."""
    path = _scratch(spark, "json")
    value = F.expr("if(event_id % 3 = 0, concat('\"', event_type, '\"'), cast(user_id as string))")
    line = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "value": '), value, F.lit("}"))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    df = read_json(spark, path, mixed=["value"], lines=True)
    rows = run_checks(df, [accuracy.types(Shape.of(df))])
    return rows.where(F.col("column").isNotNull()).select(
        "column", F.col("detail")["expected"].alias("expected"), F.col("numerator").alias("violations"),
        F.col("denominator").alias("checked"),
    )


_NOTES = """notes AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'int' ELSE 'str' END AS kind,
  CASE event_id % 4 WHEN 0 THEN CAST(10000 + user_id AS VARCHAR) WHEN 1 THEN '  ' WHEN 2 THEN 'miXed' ELSE '12345-6789' END AS zip
  FROM events)"""


@query(
    "json_mixed_default",
    f"""WITH {_NOTES} SELECT 'zip' AS "column", 'Data Type Consistency' AS name, least(count(*) FILTER (kind = 'int'),
      count(*) FILTER (kind = 'str')) AS numerator, count(*) AS denominator FROM notes
    UNION ALL SELECT 'zip', 'Empty String Rate', count(*) FILTER (trim(zip) = ''), count(*) FROM notes
    UNION ALL SELECT 'zip', 'Format Accuracy', count(*) FILTER (NOT regexp_matches(zip, '{FORMATS["zip"]}')), count(*) FROM notes
    UNION ALL SELECT 'zip', 'Case Consistency', NULL, NULL""",
)
def _(spark, sf):
    """Events through JSON lines with numbers and texts in a column, found without being told; the checks of
    texts take the text of every value."""
    path = _scratch(spark, "json")
    value = F.expr("""CASE event_id % 4 WHEN 0 THEN cast(10000 + user_id as string) WHEN 1 THEN '"  "' WHEN 2 THEN '"miXed"'
        ELSE '"12345-6789"' END""")
    line = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "zip": '), value, F.lit(', "note": null, "word": "plain"}'))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    df = read_json(spark, path, lines=True)
    shape = Shape.of(df)
    rows = run_checks(df, [accuracy.types(shape), completeness.blanks(shape), accuracy.formats(shape), consistency.letter_case(shape)])
    return rows.where(F.col("column").isNotNull()).select("column", "name", "numerator", "denominator")


@query(
    "csv_ragged",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def _(spark, sf):
    """Orders through CSV files in which every fifth row lacks its last field."""
    path = _scratch(spark, "csv")
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    rows = table(spark, sf, "orders").select(*names)
    whole, short = F.concat_ws(",", *names), F.concat_ws(",", *names[:2])
    line = F.when(F.col("o_orderkey") % 5 == 0, short).otherwise(whole)
    # the first row of each file is preceded by the header
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = rows.select(line.alias("line"), first.alias("first"))
    head = F.when(F.col("first"), F.array(F.lit(",".join(names)), F.col("line"))).otherwise(F.array("line"))
    lines.select(F.explode(head).alias("value")).write.text(path)
    return read_csv(spark, path)

"""Derived inputs: the given tables with dirt added by plain expressions on their keys.

The text of a view is the same for Spark and for the oracle; no view picks a subset of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_CUSTOMER = """
SELECT r.row_id,
  k AS customer_id,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN '   ' WHEN k % 11 = 0 THEN 'mcDonald Ltd'
       ELSE concat('Customer ', CAST(k AS STRING)) END AS customer_name,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN 'bad at mail'
       ELSE concat('user', CAST(k AS STRING), '@mail.com') END AS email,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 5 = 0 THEN concat('+1-555-', lpad(CAST(k AS STRING), 5, '0'))
       ELSE concat('+1555', lpad(CAST(k AS STRING), 7, '0')) END AS phone,
  CASE WHEN k % 31 = 0 THEN '1234' WHEN k % 2 = 0 THEN lpad(CAST(k AS STRING), 5, '0')
       ELSE concat(lpad(CAST(k AS STRING), 5, '0'), '-0001') END AS zip_code,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 101 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS balance,
  CASE WHEN k % 41 = 0 THEN 'not a date'
       ELSE concat('2024-01-', lpad(CAST(k % 28 + 1 AS STRING), 2, '0')) END AS open_date,
  CASE WHEN k % 43 = 0 THEN '2023-12-31' WHEN k % 6 = 0 THEN NULL ELSE '2024-06-30' END AS close_date,
  c_mktsegment AS status
FROM (SELECT c_custkey AS row_id, c_custkey AS k, c_acctbal, c_mktsegment FROM customer
      UNION ALL
      SELECT c_custkey + 1000000, c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0) r
"""

# Values of several JSON types in one column.
MIXED_ORDERS = """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '"x"' WHEN o_orderkey % 11 = 0 THEN 'true'
       WHEN o_orderkey % 13 = 0 THEN '2.5' ELSE CAST(o_orderkey AS STRING) END AS payload,
  CASE WHEN o_orderkey % 19 = 0 THEN 'null' ELSE '"ok"' END AS note
FROM orders
"""

SCORE_DAYS = """
SELECT event_type AS dataset_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day,
  count(*) AS total_records,
  CAST(sum(CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_null_values,
  CAST(sum(CASE WHEN value > 300 THEN 1 ELSE 0 END) AS BIGINT) AS high_values,
  CAST(sum(CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged
FROM events GROUP BY 1, 2
"""

# Spellings of part names that differ in case, ending or an extra word.
PART_NAMES = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, 's') WHEN p_partkey % 11 = 0 THEN concat(p_name, ' x')
       WHEN p_partkey % 13 = 0 THEN upper(p_name) ELSE p_name END AS p_name
FROM part
"""

_SOURCES = {
    "dirty_customer": (DIRTY_CUSTOMER, ["customer"]),
    "mixed_orders": (MIXED_ORDERS, ["orders"]),
    "score_days": (SCORE_DAYS, ["events"]),
    "part_names": (PART_NAMES, ["part"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input over the parquet tables of ``sf_dir``."""
    sql, sources = _SOURCES[name]
    return spark.sql(
        _with_placeholders(sql, sources), **{source: table(spark, sf_dir, source) for source in sources}
    )


def _with_placeholders(sql: str, sources: list[str]) -> str:
    for source in sources:
        sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}")
    return sql


def oracle_view(name: str) -> str:
    return f"{name} AS ({_SOURCES[name][0]})"

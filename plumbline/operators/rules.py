"""Threshold rules over scores, and the alerts they raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scoring import BY_COLUMN_METRICS, DIMENSIONS
from plumbline.plans.scale import join_checked

RULE_SCHEMA = (
    "rule_id string, name string, dimension string, description string, column string, "
    "threshold double, severity string, enabled boolean, parameters map<string,string>"
)
MAX_RULES = 10_000


def judge(
    rules: DataFrame, scores: DataFrame, metrics: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Enabled rules with the ``score`` they look at and whether they ``failed``.

    A rule without a column reads its dimension's score, zero where there is none. A rule with a column
    reads that column's part of a by-column metric of its dimension and is left out where there is none.
    With ``keys`` every rule is judged for every group present in ``scores``.
    """
    keys = list(keys)
    active = rules.where("enabled")
    general = active.where(F.col("column").isNull())
    if keys:
        # every group gets a row for every dimension of the rules, so that a missing one reads as zero
        named = general.agg(F.collect_set("dimension").alias("__named"))
        known = F.map_from_entries(F.collect_list(F.struct("dimension", "score")))
        board = scores.groupBy(*keys).agg(known.alias("__known"))
        wanted = F.array_union(F.array(*map(F.lit, DIMENSIONS)), F.col("__named"))
        board = board.join(F.broadcast(named)).select(*keys, "__known", F.explode(wanted).alias("dimension"))
        board = board.select(*keys, "dimension", F.coalesce(F.col("__known")[F.col("dimension")], F.lit(0.0)).alias("score"))
        judged = join_checked(board, general, ["dimension"], max_rows=MAX_RULES)
    else:
        judged = general.join(scores.select("dimension", "score"), "dimension", "left").withColumn(
            "score", F.coalesce("score", F.lit(0.0))
        )
    if metrics is not None:
        parts = metrics.where(F.col("name").isin(*BY_COLUMN_METRICS) & F.col("column").isNotNull()).select(
            *keys, "dimension", "column", F.col("value").alias("score")
        )
        special = join_checked(parts, active.where(F.col("column").isNotNull()), ["dimension", "column"], max_rows=MAX_RULES)
        judged = judged.unionByName(special.select(*judged.columns))
    return judged.withColumn("failed", F.col("score") < F.col("threshold"))


def verdicts(judged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, passed_rules, failed_rules, warnings)``; warnings are failed rules of that severity."""
    return judged.groupBy(*keys).agg(
        F.count_if(~F.col("failed")).alias("passed_rules"),
        F.count_if("failed").alias("failed_rules"),
        F.count_if(F.col("failed") & (F.col("severity") == "warning")).alias("warnings"),
    )


def alerts_of(judged: DataFrame, dataset_id: Column, ts: Column) -> DataFrame:
    """One alert per failed rule. The id is a digest of dataset, time and rule, so a rerun repeats it."""
    number = lambda c: F.col(c).cast("string")
    return judged.where("failed").select(
        F.sha2(F.concat_ws("|", dataset_id, ts.cast("string"), "rule_id"), 256).alias("alert_id"),
        ts.alias("ts"),
        "severity",
        "rule_id",
        F.col("name").alias("rule_name"),
        "dimension",
        F.format_string("%s failed: Score %s%% below threshold %s%%", F.col("name"), number("score"), number("threshold")).alias("message"),
        dataset_id.alias("dataset_id"),
        F.col("score").alias("metric_value"),
        "threshold",
        F.col("parameters").alias("details"),
    )

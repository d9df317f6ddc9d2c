"""The whole assessment of a table: every check, the scores, the rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, nan_as_null, ref
from plumbline.operators import accuracy, completeness, consistency, uniqueness, validity
from plumbline.operators.check import METRIC_SCHEMA, Check, run_checks
from plumbline.operators.group_quantiles import group_quantiles
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.rules import RULE_SCHEMA, alerts_of, judge, verdicts
from plumbline.operators.shared import Shared
from plumbline.operators.scoring import dimension_scores, overall_score
from plumbline.plans.scale import join_counted_keys


def single_pass_checks(shape: Shape, quartiles: dict) -> list[Check]:
    """The checks that share one aggregation."""
    return [
        completeness.overall(shape),
        completeness.by_column(shape),
        completeness.blanks(shape),
        accuracy.types(shape),
        accuracy.outliers(shape, quartiles),
        accuracy.formats(shape),
        consistency.letter_case(shape),
        consistency.date_formats(shape),
        consistency.date_order(shape),
        validity.negative_amounts(shape),
    ]


def quartile_pairs(df: DataFrame, shape: Shape) -> dict[str, tuple[float, float] | None]:
    found = exact_quantiles(df, shape.numerics, [0.25, 0.75])
    return {n: None if q is None else (q[0], q[1]) for n, q in found.items()}


def measure(
    df: DataFrame, exclude: Sequence[str] = (), approximate: bool = False, shared: Shared | None = None
) -> DataFrame:
    """Metric rows of all checks: quartile passes, one fused aggregation, one shuffle of row hashes and
    one of distinct values."""
    df = nan_as_null(df)
    shape = Shape.of(df, exclude)
    if shared:
        pairs = {n: q and (q[0], q[-1]) for n, q in shared.quartiles.items()}
    else:
        pairs = quartile_pairs(df, shape)
    fused = run_checks(df, single_pass_checks(shape, pairs))
    rows = uniqueness.row_uniqueness(df, shape, shared and shared.sets)
    distinct = uniqueness.column_uniqueness(df, shape, approximate, shared and shared.distinct)
    return fused.unionByName(rows).unionByName(distinct)


@dataclass(frozen=True)
class Assessment:
    """Small tables describing one assessed dataset."""

    dataset_id: str
    ts: datetime
    metrics: DataFrame
    dimension_scores: DataFrame
    verdicts: DataFrame
    alerts: DataFrame
    score: DataFrame


def assess(
    df: DataFrame,
    dataset_id: str,
    as_of: datetime,
    dataset_name: str | None = None,
    rules: DataFrame | None = None,
    exclude: Sequence[str] = (),
    approximate: bool = False,
    shared: Shared | None = None,
) -> Assessment:
    """Assess ``df``. The metric rows, a few per column, are computed here once; everything after works
    on them. Scores and alerts are not stored: see ``sources.writers``."""
    spark = df.sparkSession
    rows = measure(df, exclude, approximate, shared).collect()
    metrics = spark.createDataFrame(rows, METRIC_SCHEMA)
    rules = rules if rules is not None else spark.createDataFrame([], RULE_SCHEMA)
    scores = dimension_scores(metrics)
    judged = judge(rules, scores, metrics)
    counted = verdicts(judged)
    total = next(r["denominator"] for r in rows if r["name"] == uniqueness.ROWS)
    score = (
        scores.groupBy()
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "score")))).alias("dimension_scores"))
        .withColumn("__one", F.lit(1))
        .join(overall_score(scores).withColumn("__one", F.lit(1)), "__one")
        .join(counted.withColumn("__one", F.lit(1)), "__one")
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(dataset_name or dataset_id).alias("dataset_name"),
            F.lit(as_of).alias("ts"),
            "overall_score",
            F.lit(total).cast("bigint").alias("total_records"),
            "passed_rules",
            "failed_rules",
            "warnings",
            "dimension_scores",
        )
    )
    return Assessment(
        dataset_id, as_of, metrics, scores, counted, alerts_of(judged, F.lit(dataset_id), F.lit(as_of)), score
    )


def assess_groups(
    df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = (), checks: Sequence[Check] | None = None
) -> DataFrame:
    """Metric rows of all checks per group of ``keys``: a history of many datasets or days is one job, not one
    per group. The checks of a single pass share one aggregation, with the outliers among them once the quartiles
    of every group are known; repeated rows and distinct values are found within groups. With ``checks`` only
    those, without quartiles."""
    df = nan_as_null(df)
    shape = Shape.of(df, [*exclude, *keys])
    if checks:
        return run_checks(df, checks, keys)
    held = [f"__group_{i}" for i in range(len(keys))]  # so that a key may have any name
    rows = df.select(*[ref(k).alias(h) for h, k in zip(held, keys)], *[ref(n) for n in shape.names])
    chosen = [c for c in single_pass_checks(shape, {}) if not any(accuracy.RANGE in m for m in c.metrics)]
    ends = {n: (f"__q{i}_0", f"__q{i}_1") for i, n in enumerate(shape.numerics)}
    fenced = rows
    if ends:
        quartiles = group_quantiles(rows, held, shape.numerics, [0.25, 0.75])
        fenced = join_counted_keys(rows, quartiles, held, size="__rows")
    fused = run_checks(fenced, [*chosen, accuracy.group_outliers(shape, ends)], held)
    found = fused.unionByName(uniqueness.row_uniqueness(rows, shape, keys=held))
    found = found.unionByName(uniqueness.column_uniqueness(rows, shape, keys=held))
    return found.withColumnsRenamed(dict(zip(held, keys)))

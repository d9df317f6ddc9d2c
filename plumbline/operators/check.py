"""What every single-pass check is made of: aggregate measures, and metric rows computed from them.

A check contributes named aggregates (``measures``) and struct expressions over those names
(``metrics``), both as SQL text. Any number of checks run in one ``agg``, so one scan of the table and one
shuffle of a single partial row per task serve them all; grouped runs use the same expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ref, string

#: Aggregates per scan.
MAX_MEASURES = 600

METRIC_SCHEMA = (
    "dimension string, name string, column string, value double, numerator bigint, "
    "denominator bigint, detail map<string,string>"
)


@dataclass(frozen=True)
class Check:
    measures: dict[str, str] = field(default_factory=dict)
    metrics: tuple[str, ...] = ()


def metric(
    dimension: str,
    name: str,
    value: str = "NULL",
    numerator: str = "NULL",
    denominator: str = "NULL",
    column: str | None = None,
    detail: dict[str, str] | None = None,
    when: str | None = None,
) -> str:
    """One metric row; ``column`` marks the part of a metric that one column contributes, and a
    false ``when`` leaves the row out."""
    pairs = ", ".join(f"{string(key)}, CAST({text} AS STRING)" for key, text in (detail or {}).items())
    row = (
        f"named_struct('dimension', {string(dimension)}, 'name', {string(name)}, "
        f"'column', CAST({'NULL' if column is None else string(column)} AS STRING), "
        f"'value', CAST({value} AS DOUBLE), 'numerator', CAST({numerator} AS BIGINT), "
        f"'denominator', CAST({denominator} AS BIGINT), "
        f"'detail', CAST({f'map({pairs})' if pairs else 'NULL'} AS MAP<STRING, STRING>))"
    )
    return row if when is None else f"if({when}, {row}, NULL)"


def total(terms: Sequence[str]) -> str:
    """Sum of expressions; zero for none."""
    return f"({' + '.join(terms) or '0L'})"


def table_of(stats: DataFrame, rows: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per non-null struct of ``rows``, for every row of ``stats``."""
    structs = F.expr(f"explode(array({', '.join(rows)}))").alias("__row")
    return stats.select(*keys, structs).where(F.col("__row").isNotNull()).select(*keys, "__row.*")


def aggregated(df: DataFrame, measures: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """One row of all measures, per group of ``keys`` if given. So many that they would not fit generated
    code are aggregated in batches, each reading its own columns."""
    stats = None
    for number, batch in enumerate(batched(measures.items(), MAX_MEASURES)):
        held = [f"__{number}_{i}" for i in range(len(keys) or 1)]
        groups = [ref(k).alias(h) for k, h in zip(keys, held)]
        part = df.groupBy(*groups).agg(*[F.expr(sql).alias(name) for name, sql in batch])
        if not keys:  # a single row, joined on a constant
            part = part.withColumn(held[0], F.lit(1))
        if stats is None:
            stats = part
            continue
        same = [F.col(f"__0_{i}").eqNullSafe(F.col(h)) for i, h in enumerate(held)]
        stats = stats.join(part, reduce(lambda a, b: a & b, same)).drop(*held)
    return stats.withColumnsRenamed({f"__0_{i}": k for i, k in enumerate(keys)}).drop("__0_0")


def run_checks(df: DataFrame, checks: Sequence[Check], keys: Sequence[str] = ()) -> DataFrame:
    """Metric rows of all ``checks`` from one aggregation, per group of ``keys`` if given."""
    measures = {name: sql for check in checks for name, sql in check.measures.items()}
    held = [f"__group_{i}" for i in range(len(keys))]  # so that a key may have a measure's name
    grouped = df.withColumns({h: ref(k) for h, k in zip(held, keys)}) if keys else df
    rows = table_of(aggregated(grouped, measures, held), [row for check in checks for row in check.metrics], held)
    return rows.withColumnsRenamed(dict(zip(held, keys)))

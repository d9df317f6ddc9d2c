"""Results that several operators on one table need, computed once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import Shape, nan_as_null, ref
from plumbline.operators.duplicates import duplicate_sets
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.value_counts import Counted
from plumbline.plans.scale import checkpointed


@dataclass(frozen=True)
class Shared:
    """``quartiles`` by numeric column, ``distinct`` counts and ``top`` values by column, and ``sets`` of rows
    equal on all columns (nulls equal) with their first row."""

    quartiles: dict[str, list[float] | None]
    distinct: DataFrame
    top: DataFrame
    sets: DataFrame

    @classmethod
    def of(cls, df: DataFrame, shape: Shape, row_id: str) -> Shared:
        df = nan_as_null(df)
        first = F.min(ref(row_id)).alias("__first")
        counted = Counted.of(df, shape.names)
        # both come from one shuffle, in one job that leaves a few rows per column
        kept = checkpointed(counted.distinct().unionByName(counted.top(), allowMissingColumns=True))
        return cls(
            exact_quantiles(df, shape.numerics, [0.25, 0.5, 0.75]),
            kept.where("rank IS NULL").select("column", "distinct", "present"),
            kept.where("rank IS NOT NULL").select("column", "value", "n", "rank"),
            checkpointed(duplicate_sets(df, shape.names, first, nulls_equal=True)),
        )

    def complete_sets(self, shape: Shape) -> DataFrame:
        """The sets without a null in any column."""
        return self.sets.dropna(subset=shape.names)

"""How often each value of each column occurs: the one shuffle behind distinct counts, modes and tops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import ref
from plumbline.plans.scale import checkpointed, hinted

#: Texts of more octets than this, on average, are counted by a digest; so many first rows tell.
LONG_TEXT = 40
LOOKED_AT = 500
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NATIVE = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def _comparable(field: T.StructField) -> tuple[str, Column]:
    """The family a column is counted with, and its value in that family's type."""
    value, kind = ref(field.name), field.dataType
    if isinstance(kind, _WHOLE):
        return "bigint", value.cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double", value.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
    if isinstance(kind, _NATIVE):
        return kind.simpleString(), value
    if isinstance(kind, T.BinaryType):
        return "hex", F.hex(value)
    if isinstance(kind, T.VariantType):
        return "json", F.to_json(value)
    return "text", value.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(column, value, n)`` for every distinct non-null value, per group of ``keys`` if given; the value as text.

    Columns of one type are unpivoted and counted together in that type, each scan reading its own
    columns only, and turned to text after counting. Map-side combining takes care of hot values.
    """
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    families: dict[str, list[Column]] = {}
    held = [ref(k) for k in keys]
    for field in chosen:
        family, value = _comparable(field)
        families.setdefault(family, []).append(value.alias(field.name))
    counted = [
        df.select(*held, *values)
        .unpivot(held, [ref(n) for n in _names(chosen, family)], "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*held, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*held, "column", F.col("value").cast("string").alias("value"), "n")
        for family, values in families.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@dataclass(frozen=True)
class Counted:
    """How often the values of columns occur: ``values`` (column, value, n) by the value, and for texts too long to be
    shuffled ``digests`` (column, __digest, n), each proven to stand for one text; ``texts`` (column, __digest, value)
    are those columns where they are stored."""

    values: DataFrame
    digests: DataFrame | None = None
    texts: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, columns: list[str]) -> Counted:
        """Counts of all values. Long texts are counted by a digest of eight bytes; a second one finds digests
        that several texts share, whose texts are counted as they are."""
        long = long_texts(df, columns)
        if not long:
            return cls(value_counts(df, columns))
        texts = df.select(*[ref(c) for c in long]).unpivot([], [ref(c) for c in long], "column", "value").where("value IS NOT NULL")
        texts = texts.select("column", F.xxhash64("value").alias("__digest"), "value")
        other = F.xxhash64(F.lit("other"), "value")
        counted = texts.groupBy("column", "__digest").agg(
            F.count(F.lit(1)).alias("n"), (F.min(other) == F.max(other)).alias("one")
        )
        counted = checkpointed(counted)
        values = [value_counts(df, [c for c in columns if c not in long])] if len(long) < len(set(columns)) else []
        shared = counted.where("NOT one").select("column", "__digest")
        if not shared.isEmpty():
            again = texts.join(hinted(checkpointed(shared)), ["column", "__digest"], "left_semi")
            values.append(again.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        if not values:
            values = [df.sparkSession.createDataFrame([], "column string, value string, n bigint")]
        return cls(reduce(DataFrame.unionByName, values), counted.where("one").drop("one"), texts)

    def distinct(self) -> DataFrame:
        """``(column, distinct, present)`` of the columns that have values."""
        parts = [self.values.select("column", "n")]
        if self.digests is not None:
            parts.append(self.digests.select("column", "n"))
        return distinct_of(reduce(DataFrame.unionByName, parts))

    def top(self, k: int = 5) -> DataFrame:
        """The ``k`` most frequent values per column with their ``rank``; ties by value.

        Long texts are fetched for the winners only: those more frequent than the k-th, and the first texts among
        those that tie with it. Ties that occur once are limited to the first in every task before they move.
        """
        if self.digests is None:
            return top_values(self.values, k)
        best = Window.partitionBy("column").orderBy(F.col("n").desc())
        first = self.digests.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        least = {r["column"]: r["n"] for r in first.groupBy("column").agg(F.min("n").alias("n")).collect()}
        found = [top_values(self.values, k).drop("rank")]
        limits = self.digests.sparkSession.createDataFrame(list(least.items()), "column string, least bigint")
        marked = self.digests.join(F.broadcast(limits), "column")
        above = marked.where("n > least").select("column", "__digest", "n")  # fewer than k a column
        found.append(_fetched(self.texts.join(F.broadcast(above), ["column", "__digest"])))
        often = [c for c, n in least.items() if n > 1]
        ties = marked.where(F.col("column").isin(often) & (F.col("n") == F.col("least"))).select("column", "__digest", "n")
        found.append(_fetched(self.texts.join(hinted(checkpointed(ties)), ["column", "__digest"])))
        once = [c for c, n in least.items() if n == 1]
        repeated = marked.where(F.col("column").isin(once) & (F.col("n") > 1)).select("column", "__digest")
        single = self.texts.where(F.col("column").isin(once)).join(hinted(checkpointed(repeated)), ["column", "__digest"], "left_anti")
        order = Window.partitionBy("column").orderBy("value")
        single = single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        found.append(single.select("column", "value", F.lit(1).cast("bigint").alias("n")))
        return top_values(reduce(DataFrame.unionByName, found), k)


def _fetched(texts: DataFrame) -> DataFrame:
    """One text a digest; copies are combined before they move."""
    return texts.groupBy("column", "__digest").agg(F.min("value").alias("value"), F.max("n").alias("n")).select("column", "value", "n")


def long_texts(df: DataFrame, columns: list[str]) -> list[str]:
    """Text columns whose values are long, going by the first rows: this chooses how they are counted, not what
    comes out."""
    texts = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    sizes = df.select(*[F.octet_length(ref(c)).alias(f"s{i}") for i, c in enumerate(texts)]).limit(LOOKED_AT)
    means = sizes.agg(*[F.avg(f"s{i}").alias(f"s{i}") for i in range(len(texts))]).first()
    return [c for i, c in enumerate(texts) if (means[f"s{i}"] or 0) > LONG_TEXT]


def _names(fields: list[T.StructField], family: str) -> list[str]:
    return [f.name for f in fields if _comparable(f)[0] == family]


def distinct_of(counts: DataFrame) -> DataFrame:
    """``(column, distinct, present)`` of the columns that have values."""
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("present"))


def distinct_counts(
    df: DataFrame, columns: list[str], approximate: bool = False, counted: DataFrame | None = None
) -> DataFrame:
    """``(ordinal, column, distinct, present)`` per column, all-null columns included.

    ``approximate`` swaps the shuffle of distinct values for a sketch per column; ``counted`` is the result
    of ``distinct_of`` where it is known already.
    """
    names = F.explode(
        F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column")) for i, c in enumerate(columns)])
    )
    if approximate:
        stats = df.agg(
            *[F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(columns)],
            *[F.count(ref(c)).alias(f"p{i}") for i, c in enumerate(columns)],
        )
        rows = [
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(c).alias("column"),
                F.col(f"d{i}").alias("distinct"),
                F.col(f"p{i}").alias("present"),
            )
            for i, c in enumerate(columns)
        ]
        return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if counted is None:
        counted = Counted.of(df, columns).distinct()
    listed = df.sparkSession.range(1).select(names.alias("c")).select("c.ordinal", "c.column")
    return listed.join(counted, "column", "left").select(
        "ordinal",
        "column",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.coalesce("present", F.lit(0)).alias("present"),
    )


def distinct_counts_by(df: DataFrame, columns: list[str], keys: Sequence[str]) -> DataFrame:
    """``(keys, column, distinct, present)`` per group and column, columns without values included."""
    held = [ref(k) for k in keys]
    counted = value_counts(df, columns, keys).groupBy(*held, "column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("present")
    )
    none = [F.lit(0).cast("bigint").alias(c) for c in ("distinct", "present")]
    listed = df.select(*held).distinct().select(*held, F.explode(F.array(*map(F.lit, columns))).alias("column"), *none)
    return counted.unionByName(listed).groupBy(*held, "column").agg(F.sum("distinct").alias("distinct"), F.sum("present").alias("present"))


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column with their ``rank``; ties by value.

    The rank limit is applied inside each task before the shuffle by column, so at most ``k`` rows
    per column and task move.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def modes_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mode)``: the most frequent value of each column, the smallest on ties."""
    return Counted.of(df, columns).top(1).select("column", F.col("value").alias("mode"))


def modes(counts: DataFrame) -> DataFrame:
    """``(column, mode)``: the most frequent value, the smallest on ties."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("most"), F.col("value"))).alias("mode")
    )

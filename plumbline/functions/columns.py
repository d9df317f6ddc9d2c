"""Column selection by type and by name, and the single notion of a missing value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments that decide which columns a check looks at.
AMOUNT_NAMES = ("amount", "balance", "value", "price", "cost", "revenue")
DATE_NAMES = ("date", "time", "timestamp", "created", "updated")


def quoted(name: str) -> str:
    """A column name as SQL spells it, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """A column by its exact name."""
    return F.col(quoted(name))


def string(text: str) -> str:
    """A string literal in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | None) -> str:
    """A double literal in SQL, exact to the last digit."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"double('{float(value)!r}')"


def name_has(name: str, fragments: tuple[str, ...]) -> bool:
    return any(fragment in name.lower() for fragment in fragments)


@dataclass(frozen=True)
class Shape:
    """The columns of a table under assessment, in table order."""

    fields: tuple[T.StructField, ...]

    @classmethod
    def of(cls, df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> Shape:
        return cls(tuple(f for f in df.schema.fields if f.name not in exclude))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def of_type(self, *kinds: type) -> list[str]:
        return [f.name for f in self.fields if isinstance(f.dataType, kinds)]

    @property
    def strings(self) -> list[str]:
        return self.of_type(T.StringType)

    @property
    def numerics(self) -> list[str]:
        return self.of_type(T.NumericType)

    @property
    def variants(self) -> list[str]:
        return self.of_type(T.VariantType)

    @property
    def texts(self) -> dict[str, str]:
        """SQL for the text of every column that may hold texts; other values of a variant are spelled out."""
        spelled = {n: quoted(n) for n in self.strings} | {n: f"CAST({quoted(n)} AS STRING)" for n in self.variants}
        return {n: spelled[n] for n in self.names if n in spelled}

    @property
    def amounts(self) -> list[str]:
        return [n for n in self.names if name_has(n, AMOUNT_NAMES)]

    @property
    def dates(self) -> list[str]:
        return [n for n in self.names if name_has(n, DATE_NAMES)]


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column; all other columns pass through untouched,
    so that filters on them still reach the scan."""
    floating = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    return df.withColumns(
        {f.name: F.expr(f"nanvl({quoted(f.name)}, CAST(NULL AS {f.dataType.simpleString()}))") for f in floating}
    )


def share(part: str, whole: str, if_empty: float) -> str:
    """SQL for 100 * part / whole as a double, or ``if_empty`` when there is nothing to divide by."""
    return f"if(({whole}) > 0, CAST({part} AS DOUBLE) / ({whole}) * 100, {number(if_empty)})"


def rounded(value: str) -> str:
    """SQL for two decimals, ties to even."""
    return f"bround({value}, 2)"


def mean2(value: Column) -> Column:
    """The mean of values that have two decimals, to two decimals. It adds up decimals, so the result does
    not depend on the order in which tasks deliver them."""
    return round2(F.avg(value.cast("decimal(18,2)"))).cast("double")


def round2(value: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(value, 2)

"""Readers that type their columns the way the checks expect."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted, ref

# Texts that read as missing in CSV files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Names of JSON columns that hold dates.
DATE_ENDINGS, DATE_NAMES = ("_at", "_time"), ("modified", "date")

SAMPLE_ROWS, SAMPLE_LIMIT = 10, 100

#: Holds what a row has beyond the columns of the header.
SURPLUS = "__surplus"
_WHOLE = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


def read_csv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """A CSV table with a header; texts standing for missing are null, dates stay text.

    Columns become, in this order, bigint (all values whole, none missing), double (all numeric, or no
    value at all), boolean (all truth words, none missing) or string. Deciding takes one scan with one
    aggregation over all columns. A row with more fields than the header is an error.
    """
    reader = spark.read.options(**{"header": "true", "multiLine": "true", "escape": '"', **options})
    names = reader.csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in [*names, SURPLUS]]
    raw = reader.schema(T.StructType(fields)).csv(path)
    return typed(raw.select(*[_present(ref(n)).alias(n) for n in names], SURPLUS), SURPLUS)


def _present(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TEXTS), text)


def typed(texts: DataFrame, surplus: str | None = None) -> DataFrame:
    """Infer the type of every text column and cast it. The column ``surplus``, if given, must be all null."""
    names = [n for n in texts.columns if n != surplus]
    if not names:
        return texts.drop(surplus) if surplus else texts
    tests = {"whole": _is_whole, "number": lambda c: c.rlike(_NUMBER), "truth": lambda c: c.rlike(_TRUTH)}
    stats = texts.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(ref(surplus)) if surplus else F.lit(0)).alias("surplus"),
        *[F.count(ref(n)).alias(f"present{i}") for i, n in enumerate(names)],
        *[F.count_if(test(ref(n))).alias(f"{key}{i}") for i, n in enumerate(names) for key, test in tests.items()],
    ).first()
    if stats["surplus"]:
        raise ValueError(f"{stats['surplus']} rows have more fields than the header")
    chosen = []
    for i, n in enumerate(names):
        present, complete = stats[f"present{i}"], stats[f"present{i}"] == stats["rows"]
        if present and complete and stats[f"whole{i}"] == present:
            kind, value = "bigint", F.trim(ref(n))
        elif stats[f"number{i}"] == present:
            kind, value = "double", F.trim(ref(n))
        elif complete and stats[f"truth{i}"] == present:
            kind, value = "boolean", ref(n)
        else:
            kind, value = "string", ref(n)
        chosen.append(value.try_cast(kind).alias(n))
    return texts.select(*chosen)


def _is_whole(text: Column) -> Column:
    return text.rlike(_WHOLE) & F.trim(text).try_cast("bigint").isNotNull()


def read_json(
    spark: SparkSession, path: str | list[str], mixed: list[str] | None = None, lines: bool = False
) -> DataFrame:
    """Records from JSON files: an array of records per file, or with ``lines`` one record per line, which
    splits over tasks. Columns whose values are not all texts, but have no other type in common either, are
    read as variants, which keep the type of every single value. Finding them takes a scan; ``mixed`` names
    them instead, an empty list if there are none. Text columns named like dates become timestamps if all
    their values are."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    schema = reader.json(path).schema
    if mixed is None:
        # the inferred type of values of several types is string; so is that of unreadable records
        unreadable = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
        texts = [f.name for f in schema if isinstance(f.dataType, T.StringType) and f.name != unreadable]
        mixed = _mixed(_as_variants(reader, schema, texts).json(path), texts) if texts else []
    df = _as_variants(reader, schema, mixed).json(path)
    # a JSON null is a missing value, as in the other columns
    present = {n: F.when(~F.is_variant_null(ref(n)), ref(n)) for n in mixed}
    return _with_dates(df.withColumns(present) if present else df)


def _as_variants(reader: DataFrameReader, schema: T.StructType, names: list[str]) -> DataFrameReader:
    return reader.schema(T.StructType([T.StructField(f.name, T.VariantType() if f.name in names else f.dataType) for f in schema]))


def _mixed(variants: DataFrame, names: list[str]) -> list[str]:
    """The columns with any value that is neither a text nor null."""
    tests = [F.expr(f"coalesce(bool_or(schema_of_variant({quoted(n)}) NOT IN ('STRING', 'VOID')), false)") for n in names]
    return [n for n, other in zip(names, variants.agg(*tests).first()) if other]


def _with_dates(df: DataFrame) -> DataFrame:
    names = [n for n, kind in df.dtypes if kind == "string" and _is_date_name(n.lower())]
    if not names:
        return df
    tests = [F.expr(f"count_if(try_to_timestamp({quoted(n)}) IS NULL AND {quoted(n)} IS NOT NULL)") for n in names]
    failed = df.agg(*tests).first()
    return df.withColumns({n: F.try_to_timestamp(ref(n)) for n, bad in zip(names, failed) if not bad})


def _is_date_name(name: str) -> bool:
    return name.endswith(DATE_ENDINGS) or name.startswith("timestamp") or name in DATE_NAMES


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A dataset by catalog name, or by the path of its parquet files."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_stored(spark: SparkSession, folder: str, name: str, since: datetime | None = None, dataset_id: str | None = None) -> DataFrame:
    """The stored rows of ``scores``, ``dimension_scores`` or ``alerts`` below ``folder``, from a time on and of one
    data set if wanted; only the folders of these days and this data set are opened."""
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("dataset_id", F.col("dataset_id").cast("string"))
    if since is not None:
        rows = rows.where((F.col("day") >= F.lit(since.date())) & (F.col("ts") >= F.lit(since)))
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    return rows.drop("day", "assessed")


def stored_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """``(dataset_id)`` of all data sets with stored scores, from the folders alone."""
    return spark.read.parquet(f"{folder}/scores").select(F.col("dataset_id").cast("string").alias("dataset_id")).distinct()


def read_acknowledgements(spark: SparkSession, folder: str) -> DataFrame:
    """``(alert_id, ts)`` of the alerts acknowledged below ``folder``, each once with its first time; empty before
    the first one."""
    columns = "alert_id string, ts timestamp"
    try:
        rows = spark.read.schema(columns).parquet(f"{folder}/alert_acks")
        return rows.groupBy("alert_id").agg(F.min("ts").alias("ts"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], columns)


def dataset_info(df: DataFrame, dataset_id: str) -> DataFrame:
    """One row: size, column names and types."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset_id).alias("dataset_id"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.array(*[F.lit(n) for n in df.columns]).alias("column_names"),
        F.array(*[F.lit(t) for _, t in df.dtypes]).alias("dtypes"),
    )


def sample_page(df: DataFrame, order_by: list[str], limit: int = SAMPLE_ROWS, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in the given order, each with the ``total_rows`` of the table. For many or
    deep pages of a large table make a ``PageIndex`` once."""
    _check_page(limit, offset)
    total = df.agg(F.count(F.lit(1)).alias("total_rows")).first()["total_rows"]
    return df.orderBy(*order_by).offset(offset).limit(limit).withColumn("total_rows", F.lit(total).cast("bigint"))


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= SAMPLE_LIMIT or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")


@dataclass(frozen=True)
class PageIndex:
    """A table laid out by position: ranges in the given order, each a folder, and where each range starts. A page
    opens the one or two folders that hold it, however deep it lies."""

    rows: DataFrame
    columns: tuple[str, ...]
    #: (range, first position, rows) of each range.
    ranges: tuple[tuple[int, int, int], ...]

    PART, PLACE = "__range", "__place"

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str], folder: str) -> PageIndex:
        """Writes the table in order below ``folder``, which all executors see. Rows that ``order_by`` does not tell
        apart are in no order among themselves; the columns should name a row."""
        order = [ref(c) for c in order_by]
        number = F.monotonically_increasing_id()  # the range above, the place in it below
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", number)
        laid = ranged.withColumns({cls.PART: F.shiftright("__id", 33), cls.PLACE: F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")
        laid.write.mode("overwrite").partitionBy(cls.PART).parquet(folder)
        rows = df.sparkSession.read.schema(laid.schema).parquet(folder)
        found, start = [], 0
        for row in rows.groupBy(cls.PART).agg(F.count(F.lit(1)).alias("n")).orderBy(cls.PART).collect():  # one row a range
            found.append((row[cls.PART], start, row["n"]))
            start += row["n"]
        return cls(rows, tuple(df.columns), tuple(found))

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def page(self, limit: int = SAMPLE_ROWS, offset: int = 0) -> DataFrame:
        """Rows ``offset`` .. ``offset + limit`` with the ``total_rows`` of the table."""
        _check_page(limit, offset)
        wanted = [(part, start) for part, start, n in self.ranges if start < offset + limit and start + n > offset]
        at = F.lit(None).cast("bigint")
        for part, start in wanted:
            at = F.when(F.col(self.PART) == part, F.col(self.PLACE) + start).otherwise(at)
        rows = self.rows.where(F.col(self.PART).isin([part for part, _ in wanted])).withColumn("__at", at)
        rows = rows.where((F.col("__at") >= offset) & (F.col("__at") < offset + limit)).orderBy("__at")
        return rows.select(*[ref(c) for c in self.columns], F.lit(self.total).cast("bigint").alias("total_rows"))

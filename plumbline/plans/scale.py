"""Building blocks that keep plans balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted, ref
from plumbline.session import shared_folder

#: A side is broadcast only when it is counted to have at most so many rows and so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 256 * 1024 * 1024
#: A key is hot when it holds more than 1/HOT_SHARE of the rows; so at most HOT_SHARE keys are hot.
HOT_SHARE = 20_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes."""
    fixed, sizes = 8 * len(df.columns), []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(f"coalesce(octet_length({quoted(field.name)}), 0)")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            sizes.append(f"coalesce(length(to_json(struct({quoted(field.name)}))), 0)")
    count, size = df.agg(F.count(F.lit(1)), F.expr(f"sum({' + '.join([str(fixed), *sizes])})")).first()
    return count <= rows and (size or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame, rows: int) -> DataFrame | None:
    """``df`` written out once if it is counted to be small, else None. The rows stay where they are: a limit
    would send the first of every partition to one task."""
    written = checkpointed(df)
    return written if is_small(written, rows) else None


def hinted(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that is written already or cheap to read, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_checked(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to a side that is cheap to read and usually small, such as a table of rules: broadcast if it is
    found small, else a shuffle join."""
    return big.join(hinted(small, max_rows), on, how)


def join_counted_keys(
    rows: DataFrame,
    keys: DataFrame,
    on: list[str],
    size: str = "n",
    max_rows: int = BROADCAST_ROWS,
    written: bool = False,
    thin: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Inner join of ``rows`` to a table of distinct ``keys`` whose column ``size`` counts their rows.

    Few keys: one broadcast, ``rows`` do not move. Many keys: the hot ones (at most ``HOT_SHARE`` by
    construction) are broadcast to take their rows out, the other rows and keys are shuffled, where no key
    holds a large share any more. Should even the hot keys be too wide to broadcast, all are shuffled and skewed partitions split at run time.
    Keys match null to null. ``keys`` are written out first unless they are ``written`` already. Before rows are
    shuffled ``thin`` may take out, where they are, those that match no key.
    """
    keys = keys if written else checkpointed(keys)
    if is_small(keys, max_rows):
        return _null_safe_join(rows, F.broadcast(keys), on)
    rows = thin(rows) if thin else rows
    total = keys.agg(F.sum(size)).first()[0]
    hot = F.col(size) > F.lit((total or 0) / HOT_SHARE)
    hottest, others = keys.where(hot), keys.where(~hot)
    if not is_small(hottest, HOT_SHARE):
        return _null_safe_join(rows, keys, on)
    cold = _null_safe_join(rows, F.broadcast(hottest.select(*[ref(c) for c in on])), on, "left_anti")
    return _null_safe_join(rows, F.broadcast(hottest), on).unionByName(_null_safe_join(cold, others, on))


def _null_safe_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    renamed = keys.withColumnsRenamed({c: f"__key_{i}" for i, c in enumerate(on)})
    condition: Column = F.lit(True)
    for i, name in enumerate(on):
        condition = condition & ref(name).eqNullSafe(F.col(f"__key_{i}"))
    return rows.join(renamed, condition, how).drop(*[f"__key_{i}" for i in range(len(on))])

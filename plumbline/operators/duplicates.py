"""Sets of equal rows, found without moving whole rows that have no twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted, ref
from plumbline.plans.scale import BROADCAST_ROWS, checkpointed, hinted, join_counted_keys

#: Up to this many key columns of fixed width the keys are shuffled as they are.
NARROW_KEYS = 2
DIGEST = "__digest"
#: A filter of digests has two to this power of bits, in at most 2 ** (FILTER_BITS - 6) words of 64.
FILTER_BITS = 26


def is_narrow(df: DataFrame, keys: list[str]) -> bool:
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return len(keys) <= NARROW_KEYS and all(isinstance(df.schema[k].dataType, fixed) for k in keys)


def with_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds an eight-byte hash of the key columns and of which of them are null."""
    names = [quoted(k) for k in keys]
    return df.withColumn(DIGEST, F.expr(f"xxhash64({', '.join(names)}, {', '.join(f'{n} IS NULL' for n in names)})"))


def repeated_digests(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(__digest, n)`` of the hashes that more than one row has; map-side combining absorbs hot ones."""
    hashed = with_digest(df.select(*[ref(k) for k in keys]), keys).select(DIGEST)
    return hashed.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def digest_filter(digests: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``(__word, __mask)``: which lowest bits the digests have. Its size is bounded however many they are."""
    low = f"{DIGEST} & {(1 << bits) - 1}L"
    word, bit = F.expr(f"shiftright({low}, 6)"), F.expr(f"shiftleft(1L, cast({low} & 63 as int))")
    return digests.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__mask"))


def flagged(hashed: DataFrame, kept: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows with ``__hit``: whether their digest passes the filter. All digests it was made of do, and a few others;
    rows stay where they are."""
    low = f"{DIGEST} & {(1 << bits) - 1}L"
    joined = hashed.join(F.broadcast(kept), F.expr(f"shiftright({low}, 6) = __word"), "left")
    hit = F.expr(f"coalesce(getbit(__mask, cast({low} & 63 as int)) = 1, false)")
    return joined.withColumn("__hit", hit).drop("__word", "__mask")


def passing(hashed: DataFrame, kept: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    return flagged(hashed, kept, bits).where("__hit").drop("__hit")


def duplicate_sets(df: DataFrame, keys: list[str], *extra: Column, nulls_equal: bool) -> DataFrame:
    """One row per set of two or more rows equal on ``keys``: the keys, its size ``__n`` and the ``extra``
    aggregates.

    With ``nulls_equal`` two nulls match; without, rows with a null key belong to no set. Wide keys are
    first reduced to a hash; rows whose hash is alone have no twin and drop out where they are, by a filter of
    the repeated hashes whose size is fixed. Only what is left moves, once, to be grouped on the columns
    themselves, so neither a hash collision nor a row that the filter lets through changes anything.
    """
    rows = df if nulls_equal else df.dropna(subset=keys)
    if not is_narrow(df, keys):
        rows = passing(with_digest(rows, keys), checkpointed(digest_filter(repeated_digests(rows, keys))))
    return (
        rows.groupBy(*[ref(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("__n"), *extra)
        .where("__n > 1")
    )


def in_duplicate_sets(
    rows: DataFrame,
    keys: list[str],
    *extra: Column,
    nulls_equal: bool,
    max_rows: int = BROADCAST_ROWS,
    sets: DataFrame | None = None,
) -> DataFrame:
    """The rows that belong to a duplicate set, with its ``__n`` and ``extra`` aggregates.

    Rows find their set by the hash alone where the hash stands for one set and nothing else, so what is
    joined or broadcast is a few bytes per set however wide the keys are; where rows have to move, only those
    that the filter of these hashes lets through do. Hashes that collide, next to none, are joined on the columns.
    """
    rows = rows if nulls_equal else rows.dropna(subset=keys)
    if sets is None:
        sets = duplicate_sets(rows, keys, *extra, nulls_equal=True)
    if is_narrow(rows, keys):
        return join_counted_keys(rows, sets, keys, size="__n", max_rows=max_rows)
    sets = checkpointed(with_digest(sets, keys))
    carried = [c for c in sets.columns if c not in keys and c != DIGEST]
    per_hash = sets.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("sets"), *[F.first(c).alias(c) for c in carried])
    counted = repeated_digests(rows, keys).join(per_hash, DIGEST).withColumn("clean", F.expr("sets = 1 AND __n = n"))
    counted = checkpointed(counted)
    hashed = with_digest(rows, keys)
    clean = counted.where("clean").select(DIGEST, *carried)
    found = join_counted_keys(
        hashed, clean, [DIGEST], "__n", max_rows, written=True, thin=lambda rows: passing(rows, checkpointed(digest_filter(clean)))
    )
    found = found.drop(DIGEST)
    collided = counted.where("NOT clean").select(DIGEST)
    if collided.isEmpty():
        return found
    collided = hinted(checkpointed(collided), max_rows)
    apart = join_counted_keys(
        hashed.join(collided, DIGEST, "left_semi").drop(DIGEST),
        sets.join(collided, DIGEST, "left_semi").drop(DIGEST),
        keys, "__n", max_rows, written=True,
    )
    return found.unionByName(apart)


def duplicate_rows(
    df: DataFrame, keys: list[str], nulls_equal: bool = True, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Every member of every duplicate set."""
    found = in_duplicate_sets(df, keys, nulls_equal=nulls_equal, max_rows=max_rows)
    return found.select(*[ref(c) for c in df.columns])


def one_of_each(df: DataFrame, keys: list[str], *pick: Column) -> DataFrame:
    """``df`` with the rows equal on ``keys``, nulls equal, reduced to one by the ``pick`` aggregates of all
    its other columns. Rows whose hash is alone pass through where they are, but for a few; the others move once."""
    hashed = flagged(with_digest(df, keys), checkpointed(digest_filter(repeated_digests(df, keys)))).drop(DIGEST)
    reduced = hashed.where("__hit").groupBy(*[ref(k) for k in keys]).agg(*pick)
    return hashed.where("NOT __hit").drop("__hit").unionByName(reduced)


def surplus_rows(
    df: DataFrame, keys: list[str], nulls_equal: bool, sets: DataFrame | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """``rows`` and the ``extra`` rows beyond the first of each duplicate set, if they are not given computed
    here: one row, or one for each of ``groups``, within which rows are compared."""
    if sets is None:
        sets = duplicate_sets(df, [*groups, *keys], nulls_equal=nulls_equal)
    held = [ref(g) for g in groups]
    extra = sets.groupBy(*held).agg(
        F.lit(0).cast("bigint").alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("extra")
    )
    rows = df.groupBy(*held).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("extra"))
    return rows.unionByName(extra).groupBy(*held).agg(F.sum("rows").alias("rows"), F.sum("extra").alias("extra"))

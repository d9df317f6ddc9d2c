"""Distinct texts to compare, and the bounded tiles they are compared in.

Rows are first reduced to distinct texts, so any number of copies costs one comparison partner. A group
of texts to compare within (a block, or a found group) is cut by length into parts of bounded size when it
is large, and every pair of parts is a tile of its own: no task holds a whole large group, and its work is
spread over as many tasks as it has tiles. With a threshold, tiles that no similarity can reach are not built
and texts go to no part without a possible partner. Small groups share a tile. Pairs exist only as array positions
inside a task; what leaves it are matches or sums. (The scheme is block-split load balancing of published
entity-resolution work.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import nan_as_null, ref
from plumbline.functions.similarity import WORD_BITS, Records
from plumbline.functions.similarity_sums import similarity_sum
from plumbline.functions.text import block_key, sorted_tokens, text_of
from plumbline.operators.bands import can_reach, cut_at, measure_names, measured, part_ranges, partners
from plumbline.plans.scale import checkpointed, hinted, join_counted_keys

#: Texts per part of a large group; a tile holds at most about twice as many.
PART = 1_000
#: The same where similarities are only summed and all texts fit a machine word.
SUM_PART = 8_000
#: Groups of at least so many texts are summed as grids, smaller ones together as lists of pairs.
GRID = 256
MAX_TASKS = 100_000


def text_columns(count: int) -> list[str]:
    return [f"t{i}" for i in range(count)]


def word_columns(count: int) -> list[str]:
    return [f"w{i}" for i in range(count)]


def rows_as_text(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """``(row_id, t0, t1, ...)``: the lower-cased texts rows are matched by."""
    df = nan_as_null(df)
    texts = [F.lower(text_of(ref(c))).alias(t) for c, t in zip(columns, text_columns(len(columns)))]
    return df.select(ref(row_id).alias("row_id"), *texts)


def distinct_texts(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """One row per distinct combination of texts: ``first_row`` (its id), ``n`` rows, the texts, their
    sorted words and the ``block`` they are compared within."""
    texts = text_columns(len(columns))
    return (
        rows_as_text(df, columns, row_id)
        .groupBy(*texts)
        .agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"))
        .withColumn("block", block_key([F.col(t) for t in texts]))
        .withColumns({w: sorted_tokens(F.col(t)) for t, w in zip(texts, word_columns(len(columns)))})
    )


@dataclass(frozen=True)
class Tiled:
    """Texts of groups with at least two of them, keyed by the tile they are compared in."""

    rows: DataFrame
    tasks: int

    KEYS = ("bin", "hot", "part_a", "part_b")

    def apply(self, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
        return self.rows.repartition(self.tasks, *self.KEYS).groupBy(*self.KEYS).applyInPandas(function, schema)


def placed(texts: DataFrame, group: str, columns: int, part: int = PART) -> tuple[DataFrame, int, int]:
    """Texts of groups with two or more, with their measures, ``bin``, ``hot`` (the group, if cut), ``parts`` and
    ``part``; also the numbers of bins and of pairs of parts."""
    sizes = checkpointed(texts.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1))
    parts = F.ceil(F.col("m") / F.lit(part)).cast("int")
    small, tiles = sizes.agg(
        F.coalesce(F.sum(F.when(parts == 1, F.col("m"))), F.lit(0)),
        F.coalesce(F.sum(F.when(parts > 1, parts.cast("bigint") * (parts + 1) / 2)), F.lit(0)).cast("bigint"),
    ).first()
    bins = max(1, -(-small // part))
    rows = measured(join_counted_keys(texts, sizes, [group], size="m", written=True).withColumn("parts", parts), columns)
    whole = rows.where("parts = 1").select(
        "*", F.pmod(F.xxhash64(group), F.lit(bins)).alias("bin"), F.lit("").alias("hot"), F.lit(0).alias("part")
    )
    if not tiles:
        return whole, bins, tiles
    cut = cut_at(rows.where("parts > 1"), group, columns, part)
    cut = cut.withColumns({"bin": F.lit(-1).cast("bigint"), "hot": F.col(group).cast("string")})
    return whole.unionByName(cut), bins, tiles


def tiled(texts: DataFrame, group: str, part: int = PART, columns: int = 0, threshold: float | None = None) -> Tiled:
    """Every text once per tile that compares it; all pairs within a group that can reach ``threshold`` meet in
    exactly one tile."""
    rows, bins, tiles = placed(texts, group, columns, part)
    if tiles and threshold is not None:
        rows = checkpointed(rows)
        pairs = checkpointed(partners(part_ranges(rows.where("bin < 0"), columns), columns, threshold))
        tiles = pairs.where("part <= other").count()
        others = rows.where("bin < 0").join(hinted(pairs), ["hot", "part"]).where(can_reach(threshold, columns, None))
        rows = rows.where("bin >= 0").withColumn("other", F.lit(0)).unionByName(others.select(*rows.columns, "other"))
    else:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")})
    return Tiled(rows.drop("other", "parts", "m", *measure_names(columns)), int(min(max(bins + tiles, 1), MAX_TASKS)))


def tile_pairs(tile: pd.DataFrame, group: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs compared in a tile: between its two parts, or within each of its groups. The first of
    a pair is the text that occurs first, which decides whose windows count when both are equally long."""
    ids = tile["first_row"].to_numpy()
    for i, j in _unordered_pairs(tile, group):
        flip = ids[i] > ids[j]
        yield np.where(flip, j, i), np.where(flip, i, j)


def _unordered_pairs(tile: pd.DataFrame, group: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    side_a, side_b = tile["part_a"].iat[0], tile["part_b"].iat[0]
    if side_a != side_b:
        part = tile["part"].to_numpy()
        left, right = np.flatnonzero(part == side_a), np.flatnonzero(part == side_b)
        if len(left) and len(right):
            yield np.repeat(left, len(right)), np.tile(right, len(left))
        return
    pending, size = [], 0
    for at in tile.groupby(group, sort=False).indices.values():
        if len(at) > 1:
            i, j = np.triu_indices(len(at), 1)
            pending.append((at[i], at[j]))
            size += len(i)
        if size > 500_000:
            yield tuple(np.concatenate(side) for side in zip(*pending))
            pending, size = [], 0
    if pending:
        yield tuple(np.concatenate(side) for side in zip(*pending))


def records_of(rows: pd.DataFrame, columns: int) -> Records:
    return Records(
        [rows[t].tolist() for t in text_columns(columns)], [rows[w].tolist() for w in word_columns(columns)]
    )


def similar_pairs(texts: DataFrame, group: str, columns: int, threshold: float | None, part: int = PART) -> DataFrame:
    """``(group, a, b, n_a, n_b, similarity)`` for the pairs of distinct texts of a group that reach
    ``threshold``; a and b are the first rows of the two texts, a before b."""
    id_type = texts.schema["first_row"].dataType.simpleString()
    group_type = texts.schema[group].dataType.simpleString()

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        records, found = records_of(tile, columns), []
        ids, n, of = tile["first_row"].to_numpy(), tile["n"].to_numpy(), tile[group].to_numpy()
        for i, j in tile_pairs(tile, group):
            at, score = records.similar(i, j, threshold)
            i, j = i[at], j[at]
            found.append(
                pd.DataFrame({group: of[i], "a": ids[i], "b": ids[j], "n_a": n[i], "n_b": n[j], "similarity": score})
            )
        return pd.concat(found) if found else pd.DataFrame(columns=[group, "a", "b", "n_a", "n_b", "similarity"])

    schema = f"`{group}` {group_type}, a {id_type}, b {id_type}, n_a bigint, n_b bigint, similarity double"
    return tiled(texts, group, part, columns, threshold).apply(compare, schema)


def group_similarity(texts: DataFrame, group: str, columns: int, part: int | None = None) -> DataFrame:
    """``(group, size, match_score)``: the mean similarity of all pairs of rows of each group, 100 for a
    single row. Copies count by their number; only one sum per tile and group leaves a task. Large groups are cut
    into parts of ``part`` texts, else ``SUM_PART``, or ``PART`` if a text is beyond a machine word."""
    group_type = texts.schema[group].dataType.simpleString()
    names = [*text_columns(columns), *word_columns(columns)]
    if part is None:
        longest = texts.agg(F.max(F.greatest(F.lit(0), *[F.length(c) for c in names]))).first()[0] if names else 0
        part = SUM_PART if (longest or 0) <= WORD_BITS else PART

    def add_up(tile: pd.DataFrame) -> pd.DataFrame:
        if tile["part_a"].iat[0] != tile["part_b"].iat[0]:
            first = tile["part"].to_numpy() == tile["part_a"].iat[0]
            large = [(np.flatnonzero(first), np.flatnonzero(~first))]
        else:
            large = [(at,) for at in tile.groupby(group, sort=False).indices.values() if len(at) >= GRID]
        ids, n, of = tile["first_row"].to_numpy(), tile["n"].to_numpy(dtype=np.float64), tile[group].to_numpy()
        sums, rest = [], np.ones(len(tile), bool)
        for sides in large:
            rest[np.concatenate(sides)] = False
            if all(len(at) for at in sides):
                every = np.concatenate(sides)
                here, places = tile.iloc[every], np.cumsum([0, *map(len, sides)])
                lists = [[here[c].tolist() for c in some(columns)] for some in (text_columns, word_columns)]
                found = similarity_sum(*lists, n[every], ids[every], *[np.arange(a, b) for a, b in zip(places, places[1:])])
                sums.append(pd.DataFrame({group: of[every[:1]], "s": [found]}))
        if rest.any():
            small = tile[rest].reset_index(drop=True)
            records, n, of = records_of(small, columns), n[rest], of[rest]
            for i, j in tile_pairs(small, group):
                at, score = records.similar(i, j, None)
                weighted = pd.DataFrame({group: of[i[at]], "s": n[i[at]] * n[j[at]] * score})
                sums.append(weighted.groupby(group, sort=False, as_index=False)["s"].sum())
        return pd.concat(sums) if sums else pd.DataFrame(columns=[group, "s"])

    between = tiled(texts, group, part).apply(add_up, f"`{group}` {group_type}, s double")
    n = F.col("n").cast("double")
    within = texts.select(group, (n * (n - 1) / 2 * 100).alias("s"), "n")
    total = within.unionByName(between.select(group, "s", F.lit(0).cast("bigint").alias("n")))
    size, pairs = F.col("size"), F.col("size").cast("double") * (F.col("size") - 1) / 2
    return (
        total.groupBy(group)
        .agg(F.sum("s").alias("s"), F.sum("n").alias("size"))
        .select(group, "size", F.when(size > 1, F.bround(F.col("s") / pairs, 2)).otherwise(100.0).alias("match_score"))
    )


def expanded(df: DataFrame, columns: list[str], row_id: str, texts: DataFrame, *carried: Column | str) -> DataFrame:
    """Every row with what its distinct text carries: ``(row_id, *carried)``; ``texts`` are written already."""
    names = text_columns(len(columns))
    keys = texts.select(*names, "n", *carried)
    return join_counted_keys(rows_as_text(df, columns, row_id), keys, names, written=True).drop(*names, "n")

"""Fuzzy duplicate groups: within a block, in row order, an unassigned row becomes a leader and takes in
the later unassigned rows similar to it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.similarity import Records
from plumbline.operators.bands import can_reach, measure_names, part_ranges
from plumbline.operators.matching import (
    MAX_TASKS,
    PART,
    distinct_texts,
    expanded,
    group_similarity,
    placed,
    records_of,
    similar_pairs,
    tile_pairs,
)
from plumbline.plans.scale import checkpointed, hinted

THRESHOLD = 85.0
#: Texts per block seated at once.
HEADS = 200
#: A round seats on in a block until so many pairs are compared, or so many texts seated.
SEATED, DEEP = 1_000_000, 20_000
#: Least rounds of seating before the rest is settled from its matches.
ROUNDS = 2
#: Pairs that are compared in the time a round takes besides its comparisons.
ROUND = 30_000_000


def block_sizes(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """``(block, rows, texts)`` per block."""
    return (
        distinct_texts(df, columns, row_id)
        .groupBy("block")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts"))
    )


def fuzzy_pairs(
    df: DataFrame, columns: list[str], row_id: str, threshold: float = THRESHOLD, part: int = PART
) -> DataFrame:
    """Pairs of distinct texts of a block that reach ``threshold``. A pair stands for ``n_a * n_b`` pairs of
    rows; pairs of copies of one text, always alike, are not listed."""
    return similar_pairs(distinct_texts(df, columns, row_id), "block", len(columns), threshold, part)


def leaders(
    texts: DataFrame, columns: int, threshold: float = THRESHOLD, part: int = PART, heads: int = HEADS, rounds: int = ROUNDS
) -> DataFrame:
    """``(first_row, leader)`` for every distinct text of a block with two or more.

    Equals going through each block in row order. A round seats the first ``heads`` undecided texts of
    every block among themselves, then lets the leaders found take in later texts; what is alike to an
    earlier leader is never looked at again, so dense blocks empty fast and never list their pairs. Blocks
    that fit into ``heads`` are done after one round. Where few of them become leaders, a round seats on. After ``rounds``, once a round no longer halves what is left and as many more as it would take at this pace cost
    more than comparing all pairs, the rest, which has no leader so far and therefore few matches, is settled from
    its matches.
    """
    todo, _, tiles = placed(texts, "block", columns, part)
    todo = checkpointed(todo)
    ranges = part_ranges(todo.where("bin < 0"), columns) if tiles else None
    done: list[DataFrame] = []
    before, chiefs = None, 1.0
    while True:
        sizes = todo.groupBy("block").agg(F.count(F.lit(1)).alias("texts"))
        seats, pairs = F.least("texts", F.lit(heads)), F.col("texts").cast("double") * (F.col("texts") - 1) / 2
        left, largest, seats, taken_in, pairs = sizes.agg(
            F.sum("texts"), F.max("texts"), F.sum(seats), F.sum(seats * F.col("texts").cast("double")), F.sum(pairs)
        ).first()
        if not left:
            break
        worthwhile = largest <= heads or (before is not None and worth_a_round(before, left, chiefs * taken_in, pairs))
        if len(done) >= rounds and not worthwhile:
            done.append(_settle(todo.drop("m", "parts", "bin", "hot", "part", *measure_names(columns)), columns, threshold, part))
            break
        seated, led, todo = _seat(todo, seat_groups(seats, part), columns, threshold, heads, ranges)
        done.append(seated)
        before = left
        chiefs = led / seats
    if not done:
        id_type = texts.schema["first_row"].dataType.simpleString()
        return texts.sparkSession.createDataFrame([], f"first_row {id_type}, leader {id_type}")
    return reduce(DataFrame.unionByName, done)


def worth_a_round(before: int, left: int, taken_in: float, pairs: float) -> bool:
    """Whether another round of seating, which compares ``taken_in`` pairs, is better than comparing all ``pairs`` of
    the texts ``left``: as many rounds as they need at the pace of the last one, from ``before``, cost less."""
    return 2 * left <= before or left / max(1, before - left) * (taken_in + ROUND) < pairs


def seat_groups(seats: int, part: int = PART) -> int:
    """Groups for the first texts of all blocks, ``seats`` in all, so that none holds many more than a part."""
    return max(1, -(-seats // part))


def _lead(leader: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Seats texts by their matches, in order."""
    by_first = np.lexsort((second, first))
    for a, b in zip(first[by_first], second[by_first]):
        if leader[a] == a and leader[b] == b:  # a leads, b is free
            leader[b] = a


def _seat_on(leader: np.ndarray, at: np.ndarray, records: Records, threshold: float, heads: int) -> int:
    """Seats the texts of a block beyond its first ``heads``, so many at once, until SEATED pairs are compared; returns
    how many texts of the block are seated then."""
    done, compared = heads, 0
    chiefs = at[:heads][leader[at[:heads]] == at[:heads]]
    while done < len(at) and compared < SEATED:
        some = at[done : done + heads]
        i, j = np.repeat(chiefs, len(some)), np.tile(some, len(chiefs))
        found, _ = records.similar(i, j, threshold)
        np.minimum.at(leader, j[found], i[found])
        free = some[leader[some] == some]
        x, y = np.triu_indices(len(free), 1)
        found, _ = records.similar(free[x], free[y], threshold)
        _lead(leader, free[x[found]], free[y[found]])
        chiefs = np.concatenate([chiefs, free[leader[free] == free]])
        done, compared = done + len(some), compared + len(i) + len(x)
    return done


def take_in_tasks(parts: int, left: int, led: int, cores: int) -> int:
    """Tasks that compare the texts left, in so many parts, with the leaders: leaders are few, so a task has several
    parts unless these are many texts or pairs."""
    return min(parts, max(4 * cores, -(-left // (16 * PART)), -(-left * led // (PART * PART))))


def _seat(
    todo: DataFrame, groups: int, columns: int, threshold: float, heads: int, ranges: DataFrame | None
) -> tuple[DataFrame, int, DataFrame]:
    """The texts that a round decides with their leaders, how many of these it found, and the texts left."""
    id_type = todo.schema["first_row"].dataType.simpleString()
    order = Window.partitionBy("block").orderBy("first_row")
    head = todo.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(heads, DEEP))
    head = head.drop(*measure_names(columns))

    def seat(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first_row").reset_index(drop=True)
        records, near = records_of(rows, columns), []
        leader, early = np.arange(len(rows)), rows["place"].to_numpy() <= heads
        at_once = np.flatnonzero(early)
        for i, j in tile_pairs(rows[early].assign(part_a=0, part_b=0), "block"):
            at, _ = records.similar(at_once[i], at_once[j], threshold)
            near.append((at_once[i[at]], at_once[j[at]]))
        if near:
            _lead(leader, *(np.concatenate(side) for side in zip(*near)))
        if not early.all():
            for at in rows.groupby("block", sort=False).indices.values():
                early[at[: _seat_on(leader, at, records, threshold, heads)]] = True
        ids = rows["first_row"].to_numpy()
        return pd.DataFrame({"first_row": ids[early], "leader": ids[leader[early]]})

    spread = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("spread")
    seated = checkpointed(
        head.withColumn("spread", spread)
        .repartition(min(groups, MAX_TASKS), "spread")
        .groupBy("spread")
        .applyInPandas(seat, f"first_row {id_type}, leader {id_type}")
    )
    led = seated.where("first_row = leader").count()
    rest = checkpointed(todo.join(seated, "first_row", "left_anti"))
    if rest.isEmpty():
        return seated, led, rest
    chiefs = todo.join(seated.where("first_row = leader").select("first_row"), "first_row", "left_semi")
    if ranges is not None:  # leaders go to every part of their block that can hold a text alike
        near = chiefs.where("bin < 0").join(hinted(ranges), "hot").where(can_reach(threshold, columns, None))
        near = near.withColumn("part", F.col("other")).select(*chiefs.columns)
        chiefs = chiefs.where("bin >= 0").unionByName(near)
    chiefs = chiefs.select(*[F.col(c).alias(c) for c in chiefs.columns if c not in measure_names(columns)])

    def take_in(later: pd.DataFrame, leading: pd.DataFrame) -> pd.DataFrame:
        result = pd.DataFrame({"first_row": later["first_row"], "leader": pd.Series([None] * len(later), dtype=object)})
        leading = leading[leading["block"].isin(set(later["block"]))].sort_values("first_row")
        if len(later) and len(leading):
            both = pd.concat([leading, later], ignore_index=True)
            records = records_of(both, columns)
            left = leading.reset_index(drop=True).groupby("block", sort=False).indices
            pairs = [
                (np.repeat(left[block], len(at)), np.tile(at + len(leading), len(left[block])))
                for block, at in later.reset_index(drop=True).groupby("block", sort=False).indices.items()
                if block in left
            ]
            if pairs:
                i, j = (np.concatenate(side) for side in zip(*pairs))
                at, _ = records.similar(i, j, threshold)
                found = pd.Series(i[at]).groupby(j[at] - len(leading)).min()
                result.iloc[found.index, 1] = leading["first_row"].to_numpy()[found.to_numpy()]
        return result

    keys = ["bin", "hot", "part"]
    tasks = take_in_tasks(*rest.agg(F.count_distinct(*keys), F.count(F.lit(1))).first(), led, rest.sparkSession.sparkContext.defaultParallelism)
    sides = (rest.drop(*measure_names(columns)), chiefs)
    later, leading = (side.repartition(min(tasks, MAX_TASKS), *keys).groupBy(*keys) for side in sides)
    taken = checkpointed(later.cogroup(leading).applyInPandas(take_in, f"first_row {id_type}, leader {id_type}"))
    absorbed = taken.where(F.col("leader").isNotNull())
    left_over = rest.join(absorbed, "first_row", "left_anti")
    return seated.unionByName(absorbed), led, checkpointed(left_over)


def _settle(texts: DataFrame, columns: int, threshold: float, part: int) -> DataFrame:
    """Leaders from the list of matches a < b: a text without an open earlier match leads, its matches
    follow, and the matches of both are closed, until none is open."""
    matches = checkpointed(similar_pairs(texts, "block", columns, threshold, part).select("a", "b"))
    open_, followers = matches, None
    while not open_.isEmpty():  # every round closes at least one match
        ends = open_.select(F.col("a").alias("v"), F.lit(0).alias("late")).unionByName(
            open_.select(F.col("b").alias("v"), F.lit(1).alias("late"))
        )
        first = ends.groupBy(F.col("v").alias("a")).agg(F.max("late").alias("late")).where("late = 0").select("a")
        leading = hinted(checkpointed(first))
        new = checkpointed(open_.join(leading, "a", "left_semi").select(F.col("b").alias("v")).distinct())
        followers = new if followers is None else followers.unionByName(new)
        later = open_.join(leading, "a", "left_anti")
        for end in ("a", "b"):
            later = later.join(hinted(new.select(F.col("v").alias(end))), end, "left_anti")
        open_ = checkpointed(later)
    alone = texts.select("first_row")
    if followers is None:
        return alone.withColumn("leader", F.col("first_row"))
    led = matches.join(hinted(checkpointed(followers.select(F.col("v").alias("a")))), "a", "left_anti")
    chosen = led.groupBy(F.col("b").alias("first_row")).agg(F.min("a").alias("leader"))
    return alone.join(chosen, "first_row", "left").withColumn("leader", F.coalesce("leader", "first_row"))


def fuzzy_texts(
    df: DataFrame, columns: list[str], row_id: str, threshold: float = THRESHOLD, part: int = PART, heads: int = HEADS, rounds: int = ROUNDS
) -> DataFrame:
    """Distinct texts with the ``leader`` of the group they fall in, which may be themselves alone."""
    texts = checkpointed(distinct_texts(df, columns, row_id))
    led = leaders(texts, len(columns), threshold, part, heads, rounds)
    return checkpointed(texts.join(led, "first_row", "left").withColumn("leader", F.coalesce("leader", "first_row")))


def fuzzy_groups(df: DataFrame, columns: list[str], row_id: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(group_id, method, size, match_score)`` of the fuzzy groups with two or more rows."""
    scored = group_similarity(fuzzy_texts(df, columns, row_id, threshold), "leader", len(columns))
    return scored.where("size > 1").select(
        F.col("leader").cast("string").alias("group_id"), F.lit("fuzzy").alias("method"), "size", "match_score"
    )


def fuzzy_members(df: DataFrame, columns: list[str], row_id: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(group_id, method, row_id)`` of every row in a fuzzy group."""
    texts = fuzzy_texts(df, columns, row_id, threshold)
    followers = texts.where("first_row <> leader")
    followed = followers.select(F.col("leader").alias("first_row"), F.lit(True).alias("followed")).distinct()
    chiefs = texts.where("first_row = leader").join(followed, "first_row", "left").where("followed or n > 1")
    grouped = checkpointed(chiefs.drop("followed").unionByName(followers))
    return expanded(df, columns, row_id, grouped, F.col("leader").cast("string").alias("group_id")).select(
        "group_id", F.lit("fuzzy").alias("method"), "row_id"
    )

"""Exact quantiles of many columns without gathering any column in one place.

``percentile`` keeps a map of all distinct values in one buffer, which holds only for small tables.
Beyond that, a quantile sketch gives a bracket around each wanted rank, one pass counts exactly what
lies below and inside it, and the bracket is narrowed until the few values inside can be ranked. Every
pass is a scan with one partial row per task; nothing is shuffled but the last handful of values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import number, quoted

#: Up to this many present values a column is ranked by the built-in exact aggregate.
DIRECT_ROWS = 200_000
#: Sketch accuracy: a rank is met within 1/ACCURACY of the rows.
ACCURACY = 10_000
#: A bracket with at most this many rows strictly inside is ranked by a window.
GATHER_ROWS = 100_000


@dataclass
class _Bracket:
    """Values between ``low`` and ``high`` around the ranks ``first`` and ``last`` (from zero)."""

    column: str
    prob: float
    first: int
    last: int
    low: float
    high: float
    smallest: float
    largest: float
    found: dict[int, float]
    below: int = 0
    at_low: int = 0
    inside: int = 0
    at_high: int = 0

    @property
    def value(self) -> str:
        return as_double(self.column)

    @property
    def is_inside(self) -> str:
        return f"{self.value} > {number(self.low)} AND {self.value} < {number(self.high)}"

    def missing(self) -> list[int]:
        return [r for r in {self.first, self.last} if r not in self.found]


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = ACCURACY,
    gather_rows: int = GATHER_ROWS,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values. NaN must have
    been turned to null before."""
    if not columns:
        return {}
    width = 2.0 / accuracy
    marks = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-width, width)]
    points = ", ".join(map(number, marks))
    sketch = _one_row(
        df,
        {
            name: sql
            for i, c in enumerate(columns)
            for name, sql in (
                (f"n{i}", f"count({as_double(c)})"),
                (f"lo{i}", f"min({as_double(c)})"),
                (f"hi{i}", f"max({as_double(c)})"),
                (f"q{i}", f"percentile_approx({as_double(c)}, array({points}), {accuracy})"),
            )
        },
    )
    result: dict[str, list[float] | None] = {c: None for c in columns if sketch[f"n{columns.index(c)}"] == 0}
    small = [c for i, c in enumerate(columns) if 0 < sketch[f"n{i}"] <= direct_rows]
    if small:
        points = ", ".join(map(number, probs))
        exact = _one_row(df, {f"p{i}": f"percentile({as_double(c)}, array({points}))" for i, c in enumerate(small)})
        result.update({c: list(exact[f"p{i}"]) for i, c in enumerate(small)})

    brackets = []
    for i, c in enumerate(columns):
        if c in result:
            continue
        n = sketch[f"n{i}"]
        for j, p in enumerate(probs):
            rank = (n - 1) * p
            low, high = sketch[f"q{i}"][2 * j : 2 * j + 2]
            brackets.append(
                _Bracket(c, p, math.floor(rank), math.ceil(rank), low, high, sketch[f"lo{i}"], sketch[f"hi{i}"], {})
            )
    _narrow(df, brackets, accuracy, gather_rows)
    for i, c in enumerate(columns):
        if c not in result:
            result[c] = [_interpolate(b, sketch[f"n{i}"]) for b in brackets if b.column == c]
    return result


def as_double(column: str) -> str:
    return f"CAST({quoted(column)} AS DOUBLE)"


def _one_row(df: DataFrame, measures: dict[str, str]):
    return df.agg(*[F.expr(sql).alias(name) for name, sql in measures.items()]).first()


def _interpolate(bracket: _Bracket, n: int) -> float:
    """By the formula of the built-in exact aggregate, so that a table's size decides nothing."""
    place = (n - 1) * bracket.prob
    low, high = bracket.found[bracket.first], bracket.found[bracket.last]
    return low if low == high else (bracket.last - place) * low + (place - bracket.first) * high


def _narrow(df: DataFrame, brackets: list[_Bracket], accuracy: int, gather_rows: int) -> None:
    todo = [b for b in brackets if b.missing()]
    while todo:
        _count(df, todo)
        for b in todo:
            _settle_edges(b)
        todo = [b for b in todo if b.missing()]
        _gather(df, [b for b in todo if 0 < b.inside <= gather_rows])
        todo = [b for b in todo if b.missing()]
        _resketch(df, [b for b in todo if b.inside > gather_rows], accuracy)


def _count(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Exact numbers of values below, at and inside the edges of all brackets, in one scan."""
    counts = {}
    for i, b in enumerate(brackets):
        counts[f"below{i}"] = f"count_if({b.value} < {number(b.low)})"
        counts[f"low{i}"] = f"count_if({b.value} = {number(b.low)})"
        counts[f"inside{i}"] = f"count_if({b.is_inside})"
        counts[f"high{i}"] = f"count_if({b.value} = {number(b.high)})"
    row = _one_row(df, counts)
    for i, b in enumerate(brackets):
        b.below, b.at_low = row[f"below{i}"], row[f"low{i}"]
        b.inside, b.at_high = row[f"inside{i}"], row[f"high{i}"]


def _settle_edges(b: _Bracket) -> None:
    """Answer the ranks that fall on an edge; widen a bracket that misses a rank altogether."""
    end_inside = b.below + b.at_low + b.inside
    end = end_inside + (b.at_high if b.high > b.low else 0)
    low, high = b.low, b.high  # what was counted, should one rank widen the bracket and the other fall on its edge
    for rank in b.missing():
        if rank < b.below:
            b.low, b.inside = b.smallest, 0
        elif rank >= end:
            b.high, b.inside = b.largest, 0
        elif rank < b.below + b.at_low:
            b.found[rank] = low
        elif rank >= end_inside:
            b.found[rank] = high


def _gather(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Rank the distinct values inside small brackets."""
    if not brackets:
        return
    tagged = ", ".join(f"if({b.is_inside}, named_struct('b', {i}, 'v', {b.value}), NULL)" for i, b in enumerate(brackets))
    counted = (
        df.where(" OR ".join(f"({b.is_inside})" for b in brackets))
        .select(F.expr(f"explode(array_compact(array({tagged})))").alias("x"))
        .groupBy("x.b", "x.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    ranked = counted.select("b", "v", (upto - F.col("n")).alias("start"), upto.alias("stop"))
    wanted = [
        f"(b = {i} AND start <= {rank - b.below - b.at_low} AND stop > {rank - b.below - b.at_low})"
        for i, b in enumerate(brackets)
        for rank in b.missing()
    ]
    for row in ranked.where(" OR ".join(wanted)).collect():
        b = brackets[row["b"]]
        for rank in b.missing():
            if row["start"] <= rank - b.below - b.at_low < row["stop"]:
                b.found[rank] = row["v"]


def _resketch(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """Tighter edges from a sketch of the values strictly inside."""
    if not brackets:
        return
    sketches = {}
    for i, b in enumerate(brackets):
        offset = b.below + b.at_low
        ranks = [r - offset for r in b.missing()]
        marks = [
            min(max(min(ranks) / b.inside - 2.0 / accuracy, 0.0), 1.0),
            min(max((max(ranks) + 1) / b.inside + 2.0 / accuracy, 0.0), 1.0),
        ]
        inner, points = f"if({b.is_inside}, {b.value}, NULL)", ", ".join(map(number, marks))
        sketches[f"q{i}"] = f"percentile_approx({inner}, array({points}), {accuracy})"
    row = _one_row(df, sketches)
    for i, b in enumerate(brackets):
        b.low, b.high = row[f"q{i}"]

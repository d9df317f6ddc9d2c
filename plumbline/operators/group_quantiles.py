"""Exact quantiles of many columns in every group of a table, however many or large the groups are.

A group is one row of a table of brackets, one bracket for each column and probability. A sketch for each group
gives the first brackets; then each scan joins the rows to their group's brackets, counts what lies below, on and
inside them, and sketches what lies inside. Brackets narrow until few enough values are inside to be ranked, so
neither a hot group nor a wide range of values meets in one task. A group with few values is ranked as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import number, quoted, ref
from plumbline.operators.quantiles import ACCURACY, GATHER_ROWS, as_double
from plumbline.plans.scale import checkpointed, join_counted_keys

#: Steps of the sketch of a bracket.
STEPS = 64
#: A bracket: edges (none: it holds every value), the ranks it is for and their values once found, how many values
#: come before what is inside, and whether it is to be ranked or to be counted.
BRACKET = (
    "struct<low:double,high:double,first:bigint,last:bigint,at_first:double,at_last:double,before:bigint,ready:boolean,open:boolean>"
)


def quantile_names(columns: list[str], probs: list[float]) -> list[list[str]]:
    return [[f"__q{i}_{j}" for j in range(len(probs))] for i in range(len(columns))]


def group_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float], accuracy: int = ACCURACY, gather_rows: int = GATHER_ROWS
) -> DataFrame:
    """The keys, ``__rows`` and the linearly interpolated quantiles ``__q0_0``, ``__q0_1``, ... (by column and
    probability) of every group; null for a column without values. NaN must have been turned to null before;
    null keys are a group. Key columns keep their names, which no quantile may have."""
    pairs = list(product(range(len(columns)), range(len(probs))))
    named, keys = keys, [f"__g{i}" for i in range(len(keys))]
    df = df.withColumns({h: ref(k) for h, k in zip(keys, named)})
    state = checkpointed(_first(df, keys, columns, probs, accuracy, gather_rows))
    while columns:
        if not state.where("exists(__b, b -> b.ready)").isEmpty():
            state = checkpointed(_ranked(df, state, keys, columns, pairs))
        if state.where("exists(__b, b -> b.open)").isEmpty():
            break
        state = checkpointed(_counted(df, state, keys, columns, pairs, accuracy, gather_rows))
    out = []
    for b, (i, j) in enumerate(pairs):
        place, low, high = f"((__n[{i}] - 1) * {number(probs[j])})", f"__b[{b}].at_first", f"__b[{b}].at_last"
        between = f"(__b[{b}].last - {place}) * {low} + ({place} - __b[{b}].first) * {high}"  # as over a whole table
        out.append(F.expr(f"if({low} = {high}, {low}, {between})").alias(f"__q{i}_{j}"))
    return state.select(*[F.col(h).alias(k) for h, k in zip(keys, named)], "__rows", *out)


def _first(df: DataFrame, keys: list[str], columns: list[str], probs: list[float], accuracy: int, gather_rows: int) -> DataFrame:
    """Brackets from a sketch of each group; few values are one bracket without edges."""
    width = 2.0 / accuracy
    marks = ", ".join(number(min(max(p + d, 0.0), 1.0)) for p in probs for d in (-width, width))
    measures = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        value = as_double(c)
        for name, sql in (
            (f"n{i}", f"count({value})"), (f"least{i}", f"min({value})"), (f"most{i}", f"max({value})"),
            (f"sketch{i}", f"percentile_approx({value}, array({marks}), {accuracy})"),
        ):
            measures.append(F.expr(sql).alias(name))
    stats = df.groupBy(*[ref(k) for k in keys]).agg(*measures)
    arrays = {f"__{name}": F.array(*[F.col(f"{name}{i}") for i in range(len(columns))]) for name in ("n", "least", "most")}
    arrays["__sketch"] = F.array(*[F.col(f"sketch{i}") for i in range(len(columns))])
    stats = stats.select(*[ref(k) for k in keys], "__rows", *[a.alias(n) for n, a in arrays.items()])

    def start(row: dict) -> list[dict]:
        out = []
        for i, j in product(range(len(columns)), range(len(probs))):
            n, rank = row["__n"][i], (row["__n"][i] - 1) * probs[j]
            many = n > gather_rows
            low, high = (row["__sketch"][i][2 * j : 2 * j + 2]) if many else (None, None)
            out.append({
                "low": low, "high": high, "first": math.floor(rank), "last": math.ceil(rank), "at_first": None, "at_last": None,
                "before": 0, "ready": 0 < n <= gather_rows, "open": many,
            })
        return out

    return _updated(stats, ["__sketch"], start)


def _updated(groups: DataFrame, used: list[str], function: Callable[[dict], list[dict]]) -> DataFrame:
    """The table of groups with the brackets that ``function`` gives for each row, without the columns ``used``."""
    kept = [f for f in groups.schema.fields if f.name not in (*used, "__b")]
    schema = T.StructType([*kept, T.StructField("__b", T._parse_datatype_string(f"array<{BRACKET}>"))])
    reads = [c for c in groups.columns if c.startswith("__")]

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(*[frame[c].tolist() for c in reads]) if len(frame) else []
            brackets = [function(dict(zip(reads, row))) for row in rows]
            yield frame[[f.name for f in kept]].assign(__b=pd.Series(brackets, index=frame.index, dtype=object))

    return groups.mapInPandas(update, schema)


def _bracket(column: str, b: int) -> str:
    """Whether a value is inside a bracket."""
    value = as_double(column)
    return f"({value} IS NOT NULL AND (__b[{b}].low IS NULL OR ({value} > __b[{b}].low AND {value} < __b[{b}].high)))"


def _joined(df: DataFrame, state: DataFrame, keys: list[str], columns: list[str], wanted: str) -> DataFrame:
    """Rows with the brackets of their group, of groups that have ``wanted`` ones."""
    rows = df.select(*[ref(k) for k in keys], *[ref(c) for c in columns])
    groups = state.where(f"exists(__b, b -> b.{wanted})").select(*[ref(k) for k in keys], "__rows", "__b")
    return join_counted_keys(rows, groups, keys, size="__rows", written=True)


def join_back(state: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The table of groups with what was found for some of them."""
    renamed = found.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    same = " AND ".join(f"{quoted(k)} <=> __key{i}" for i, k in enumerate(keys)) or "true"
    return state.join(renamed, F.expr(same), "left").drop(*[f"__key{i}" for i in range(len(keys))])


def _ranked(df: DataFrame, state: DataFrame, keys: list[str], columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Settles the brackets that are ready: their distinct values are counted and ranked, each bracket's apart."""
    tags = []
    for b, (i, _) in enumerate(pairs):
        every = ", ".join(f"__b[{x}].{end}" for x, (a, _) in enumerate(pairs) if a == i for end in ("first", "last"))
        own = f"__b[{b}].first - __b[{b}].before, __b[{b}].last - __b[{b}].before"
        # the brackets of a column that hold every value are one
        tags.append(
            f"if(__b[{b}].ready AND {_bracket(columns[i], b)}, named_struct('c', if(__b[{b}].low IS NULL, {-1 - i}, {b}), "
            f"'wanted', if(__b[{b}].low IS NULL, array({every}), array({own})), 'v', {as_double(columns[i])}), NULL)"
        )
    held = [ref(k) for k in keys]
    rows = _joined(df, state, keys, columns, "ready")
    tagged = rows.select(*held, F.explode(F.expr(f"array_distinct(array_compact(array({', '.join(tags)})))")).alias("__x"))
    counted = tagged.groupBy(*held, "__x").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*held, "__x.c").orderBy("__x.v"))
    found = counted.select(*held, "__x", (upto - F.col("__n")).alias("start"), upto.alias("stop"))
    found = found.where("exists(__x.wanted, r -> start <= r AND stop > r)")
    found = found.groupBy(*held).agg(F.collect_list(F.struct("__x.c", "__x.v", "start", "stop")).alias("__found"))

    def settle(row: dict) -> list[dict]:
        out = []
        for b, old in enumerate(row["__b"]):
            new = dict(old)
            if new["ready"]:
                own = -1 - pairs[b][0] if _absent(new["low"]) else b
                for end in ("first", "last"):
                    rank = new[end] - new["before"]
                    if _absent(new[f"at_{end}"]):
                        new[f"at_{end}"] = next(x["v"] for x in row["__found"] if x["c"] == own and x["start"] <= rank < x["stop"])
                new["ready"] = False
            out.append(new)
        return out

    return _updated(join_back(state, found, keys), ["__found"], settle)


def _absent(value: float | None) -> bool:
    return value is None or value != value


def _counted(
    df: DataFrame, state: DataFrame, keys: list[str], columns: list[str], pairs: list[tuple[int, int]], accuracy: int, gather_rows: int
) -> DataFrame:
    """One scan: counts the open brackets, settles the ranks that fall on their edges, and narrows the others."""
    points = ", ".join(number(s / STEPS) for s in range(STEPS + 1))
    measures = {"below": [], "on_low": [], "inside": [], "on_high": [], "sketch": []}
    for b, (i, _) in enumerate(pairs):
        value, inside = as_double(columns[i]), f"__b[{b}].open AND {_bracket(columns[i], b)}"
        measures["below"].append(f"count_if(__b[{b}].open AND {value} < __b[{b}].low)")
        measures["on_low"].append(f"count_if(__b[{b}].open AND {value} = __b[{b}].low)")
        measures["inside"].append(f"count_if({inside})")
        measures["on_high"].append(f"count_if(__b[{b}].open AND {value} = __b[{b}].high)")
        measures["sketch"].append(f"percentile_approx(if({inside}, {value}, NULL), array({points}), {accuracy})")
    flat = [F.expr(sql).alias(f"{name}{b}") for name, list_ in measures.items() for b, sql in enumerate(list_)]
    found = _joined(df, state, keys, columns, "open").groupBy(*[ref(k) for k in keys]).agg(*flat)
    found = found.select(
        *[ref(k) for k in keys], *[F.array(*[F.col(f"{name}{b}") for b in range(len(pairs))]).alias(f"__{name}") for name in measures]
    )

    def narrow(row: dict) -> list[dict]:
        return [
            _narrowed(dict(old), *[row[f"__{name}"][b] for name in measures], row["__least"][pairs[b][0]], row["__most"][pairs[b][0]], accuracy, gather_rows)
            if old["open"] else dict(old)
            for b, old in enumerate(row["__b"])
        ]

    return _updated(join_back(state, found, keys), [f"__{name}" for name in measures], narrow)


def _narrowed(
    b: dict, below: int, on_low: int, inside: int, on_high: int, sketch: list[float] | None, least: float, most: float, accuracy: int, gather_rows: int
) -> dict:
    """A counted bracket with the ranks found that fall on an edge; then ranked, widened if it misses a rank, or
    narrowed by the sketch of what is inside."""
    within = below + on_low
    end = within + inside + (on_high if b["high"] > b["low"] else 0)
    b["before"], missed = within, False
    low, high, open_ranks = b["low"], b["high"], []
    for side in ("first", "last"):
        rank = b[side]
        if not _absent(b[f"at_{side}"]):
            continue
        if rank < below:
            b["low"], missed = least, True
        elif rank < within:
            b[f"at_{side}"] = low
        elif rank < within + inside:
            open_ranks.append(rank - within)
        elif rank < end:
            b[f"at_{side}"] = high
        else:
            b["high"], missed = most, True
    if missed:
        return b
    b["open"] = bool(open_ranks) and inside > gather_rows
    b["ready"] = bool(open_ranks) and not b["open"]
    if b["open"]:
        slack = 2.0 / accuracy
        b["low"] = sketch[max(0, math.floor((min(open_ranks) / inside - slack) * STEPS))]
        b["high"] = sketch[min(STEPS, math.ceil(((max(open_ranks) + 1) / inside + slack) * STEPS))]
    return b

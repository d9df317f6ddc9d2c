"""Which texts of a cut group can be alike at all, from their lengths and the characters they can share.

The similarity of two texts is a blend of ratios 200 * common / (length + length). A ratio cannot exceed what
the lengths allow, nor what two halves of the alphabet allow, counted apart. Both bounds hold for ranges of
lengths and counts as they do for single texts, so a pair of parts whose bound stays below the threshold needs
no comparison, and a text goes only to parts that can hold a partner. Nothing alike is ever missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.similarity import PLAIN, WINDOW, WORDS
from plumbline.plans.scale import checkpointed

#: One half of the usual letters and digits, common and rare ones alike; any fixed set of characters would do.
HALF = "acegikmoqsuwy02468"
#: Rounding of a ratio may add this much.
ROUNDED = 0.5
SLACK = 1e-6


def measure_names(columns: int) -> list[str]:
    """For each column the length of its text and of its sorted words, and how many of their characters are in
    ``HALF``."""
    return [f"__{kind}{what}{i}" for i in range(columns) for kind in "tw" for what in ("n", "h")]


def measured(texts: DataFrame, columns: int) -> DataFrame:
    """Texts (t0, w0, t1, ...) with their measures."""
    added = {}
    for i in range(columns):
        for kind in "tw":
            text = F.col(f"{kind}{i}")
            added[f"__{kind}n{i}"] = F.length(text)
            added[f"__{kind}h{i}"] = F.length(text) - F.length(F.translate(text, HALF, ""))
    return texts.withColumns(added) if added else texts


def place_of(columns: int) -> tuple[Column, Column]:
    """By what texts of a group are put in order before they are cut into parts: the length of their words, exact
    up to 64 and in sixty-four steps for each doubling beyond, then their share of ``HALF`` in sixteen steps."""
    if not columns:
        return F.lit(0).cast("long"), F.lit(0).cast("long")
    size = F.expr(" + ".join(f"__wn{i}" for i in range(columns)))
    half = F.expr(" + ".join(f"__wh{i}" for i in range(columns)))
    band = F.when(size < 64, size.cast("long")).otherwise(F.floor(64 * F.log2(size / 64.0)) + 64)
    return band, F.when(size > 0, F.floor(16.0 * half / size)).otherwise(0).cast("long")


def cut_at(rows: DataFrame, group: str, columns: int, part: int) -> DataFrame:
    """Rows of large groups with their ``part``: ranges in the order of ``place_of``, ties by a hash, of about
    ``part`` rows each. What orders them is counted first, so no group is sorted in one place."""
    from pyspark.sql import Window

    from plumbline.plans.scale import join_counted_keys

    band, level = place_of(columns)
    rows = rows.withColumns({"__band": band, "__level": level})
    cells = rows.groupBy(group, "__band", "__level").agg(F.count(F.lit(1)).alias("__cell"))
    order = Window.partitionBy(group).orderBy("__band", "__level").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__cell").over(order), F.lit(0)))
    rows = join_counted_keys(rows, cells, [group, "__band", "__level"], size="__cell")
    within = F.pmod(F.xxhash64("first_row"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    number = F.floor((F.col("__before") + within * F.col("__cell")) / F.lit(part))
    number = F.least(number, F.col("parts") - 1).cast("int")
    return rows.withColumn("part", number).drop("__band", "__level", "__cell", "__before")


def part_ranges(rows: DataFrame, columns: int) -> DataFrame:
    """(hot, other, ranges of all measures) of the parts of cut groups, written out."""
    low_high = [
        agg
        for i in range(columns)
        for kind in "tw"
        for n, h in [(f"__{kind}n{i}", f"__{kind}h{i}")]
        for agg in (
            F.min(n).alias(f"{n}_low"), F.max(n).alias(f"{n}_high"), F.max(h).alias(f"{h}_high"),
            F.max(F.col(n) - F.col(h)).alias(f"__{kind}o{i}_high"),
        )
    ]
    return checkpointed(rows.groupBy("hot", F.col("part").alias("other")).agg(F.count(F.lit(1)).alias("texts"), *low_high))


def _of_row(kind: str, i: int) -> dict[str, str]:
    n, h = f"__{kind}n{i}", f"__{kind}h{i}"
    return {"low": n, "high": n, "half": h, "rest": f"({n} - {h})"}


def _of_part(kind: str, i: int, alias: str = "") -> dict[str, str]:
    dot = f"{alias}." if alias else ""
    return {
        "low": f"{dot}__{kind}n{i}_low", "high": f"{dot}__{kind}n{i}_high",
        "half": f"{dot}__{kind}h{i}_high", "rest": f"{dot}__{kind}o{i}_high",
    }


def _shared(a: dict[str, str], b: dict[str, str]) -> str:
    """No two texts have more characters in common."""
    halves = f"least({a['half']}, {b['half']}) + least({a['rest']}, {b['rest']})"
    return f"least({halves}, {a['high']}, {b['high']})"


def _ratio(a: dict[str, str], b: dict[str, str]) -> str:
    by_characters = f"coalesce(200D * {_shared(a, b)} / nullif({a['low']} + {b['low']}, 0), 100D)"
    by_length = (
        f"CASE WHEN {a['high']} < {b['low']} THEN 200D * {a['high']} / ({a['high']} + {b['low']}) "
        f"WHEN {b['high']} < {a['low']} THEN 200D * {b['high']} / ({b['high']} + {a['low']}) ELSE 100D END"
    )
    return f"least(100D, {ROUNDED}D + {by_characters}, {ROUNDED}D + {by_length})"


def _window(a: dict[str, str], b: dict[str, str]) -> str:
    shared = _shared(a, b)
    return f"least(100D, {ROUNDED}D + coalesce(200D * {shared} / nullif(least({a['low']}, {b['low']}) + {shared}, 0), 100D))"


def can_reach(threshold: float, columns: int, left: str | None, right: str | None = None) -> str:
    """SQL for whether texts may reach ``threshold``: two parts by their aliases, or (``left`` None) a row and the
    part beside it."""
    bounds = []
    for i in range(columns):
        sides = [[_of_row(k, i) if left is None else _of_part(k, i, left), _of_part(k, i, right or "")] for k in "tw"]
        (a, b), words = sides
        blend = f"{WORDS}D * {_ratio(*words)} + {WINDOW}D * {_window(a, b)} + {PLAIN}D * {_ratio(a, b)}"
        # an empty text is like an empty one only
        apart = f"({a['high']} = 0 AND {b['low']} > 0) OR ({b['high']} = 0 AND {a['low']} > 0)"
        bounds.append(f"CASE WHEN {a['low']} = 0 AND {b['low']} = 0 THEN 100D WHEN {apart} THEN 0D ELSE {blend} END")
    return f"({' + '.join(bounds)}) / {columns}D >= {threshold - SLACK!r}D" if bounds else "true"


def partners(ranges: DataFrame, columns: int, threshold: float) -> DataFrame:
    """(hot, part, other, ranges of the other) for every ordered pair of parts of a group that can hold texts
    alike, a part with itself included."""
    left = ranges.alias("l")
    right = ranges.withColumnRenamed("hot", "__hot").alias("r")
    near = F.expr(f"l.hot = r.__hot AND {can_reach(threshold, columns, 'l', 'r')}")
    return left.join(right, near).select("l.hot", F.col("l.other").alias("part"), F.col("r.other").alias("other"), *[f"r.{c}" for c in ranges.columns if c.startswith("__")])

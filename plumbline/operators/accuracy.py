"""Accuracy: mixed value types, numeric outliers and text formats."""

from __future__ import annotations

from plumbline.functions.columns import Shape, number, quoted, rounded, share, string
from plumbline.functions.text import FORMATS, breaks_format
from plumbline.operators.check import Check, metric, total

DIMENSION = "accuracy"
TYPES, RANGE, FORMAT = "Data Type Consistency", "Numeric Range Accuracy", "Format Accuracy"

#: Classes a variant value may have, as a pattern of its schema text.
VALUE_CLASSES = {
    "bool": "BOOLEAN%",
    "dict": "OBJECT%",
    "float": "D%",
    "int": "BIGINT%",
    "list": "ARRAY%",
    "str": "STRING%",
}
FENCE = 1.5


def types(shape: Shape) -> Check:
    """Columns holding values of more than one type.

    A typed column cannot; a variant column can: its most frequent class is expected (by name on
    ties) and the rest are violations. Single-precision values count as ``float`` with the others.
    """
    measures, flags, parts = {"rows": "count(*)"}, [], []
    for i, n in enumerate(shape.names):
        if n not in shape.variants:
            continue
        counts = {kind: f"kind_{i}_{kind}" for kind in VALUE_CLASSES}
        for kind, pattern in VALUE_CLASSES.items():
            text = f"schema_of_variant({quoted(n)})"
            test = f"{text} LIKE {string(pattern)}" + (f" OR {text} = 'FLOAT'" if kind == "float" else "")
            measures[counts[kind]] = f"count_if({test})"
        top, values = f"greatest({', '.join(counts.values())})", total(list(counts.values()))
        expected = " ".join(f"WHEN {c} = {top} THEN '{kind}'" for kind, c in counts.items())
        violations = f"({values} - {top})"
        flags.append(f"if({violations} > 0, 1L, 0L)")
        parts.append(
            metric(
                DIMENSION, TYPES, "NULL", violations, values, column=n,
                detail={"expected": f"CASE {expected} END"}, when=f"{violations} > 0",
            )
        )
    flagged, width = total(flags), f"{len(shape.names)}L"
    score = rounded(f"100 - {share(flagged, width, 0)}")
    return Check(measures, (metric(DIMENSION, TYPES, score, flagged, width), *parts))


def is_outlier(name: str, quartiles: tuple[float, float] | None) -> str:
    """Strictly outside the fences one and a half interquartile ranges beyond the quartiles."""
    if quartiles is None:
        return "false"
    low, high = quartiles
    reach = FENCE * (high - low)
    return f"({quoted(name)} < {number(low - reach)} OR {quoted(name)} > {number(high + reach)})"


def group_outliers(shape: Shape, quartiles: dict[str, tuple[str, str]]) -> Check:
    """Outliers per numeric column in each group of rows that carry the quartiles of their group: the names of
    the two columns that hold them."""
    tests, ends, measures = {}, {}, {}
    for i, n in enumerate(shape.names):
        if n in quartiles:
            low, high = map(quoted, quartiles[n])
            reach = f"{FENCE}D * ({high} - {low})"
            tests[n] = f"({quoted(n)} < {low} - {reach} OR {quoted(n)} > {high} + {reach})"
            ends[n] = (f"q1_{i}", f"q3_{i}")
            measures |= {f"q1_{i}": f"max({low})", f"q3_{i}": f"max({high})"}
    return _outliers(shape, tests, ends, measures)


def outliers(shape: Shape, quartiles: dict[str, tuple[float, float] | None]) -> Check:
    """Outliers per numeric column over all rows. The score adds up the columns, so it may fall
    below zero."""
    tests = {n: is_outlier(n, quartiles.get(n)) for n in shape.numerics}
    ends = {n: (number(q[0]), number(q[1])) for n, q in quartiles.items() if q is not None}
    return _outliers(shape, tests, ends, {})


def _outliers(shape: Shape, tests: dict[str, str], ends: dict[str, tuple[str, str]], measures: dict[str, str]) -> Check:
    counts = {n: f"outlier_{i}" for i, n in enumerate(shape.names) if n in shape.numerics}
    found = total(list(counts.values()))
    parts = []
    for n, c in counts.items():
        detail = {"q1": ends[n][0], "q3": ends[n][1]} if n in ends else None
        value = rounded(share(c, "rows", 0))
        parts.append(metric(DIMENSION, RANGE, value, c, "rows", column=n, detail=detail, when=f"{c} > 0"))
    score = rounded(f"100 - {share(found, 'rows', 0)}")
    return Check(
        {"rows": "count(*)", **{c: f"count_if({tests[n]})" for n, c in counts.items()}, **measures},
        (metric(DIMENSION, RANGE, score, found, "rows"), *parts),
    )


def formats(shape: Shape) -> Check:
    """Text columns named after a known format against its pattern; absent when nothing was checked.

    A name with two fragments is tested against both patterns.
    """
    tests = [
        (n, kind, f"bad_{i}_{kind}", f"present_{i}")
        for i, n in enumerate(shape.names)
        if n in shape.texts
        for kind in FORMATS
        if kind in n.lower()
    ]
    measures, parts = {"rows": "count(*)"}, []
    for n, kind, bad, present in tests:
        measures[bad] = f"count_if({breaks_format(shape.texts[n], kind)})"
        measures[present] = f"count({shape.texts[n]})"
        detail = {"expected_format": string(kind)}
        value = rounded(share(bad, present, 0))
        parts.append(metric(DIMENSION, FORMAT, value, bad, present, column=n, detail=detail, when=f"{bad} > 0"))
    checked, broken = total([present for *_, present in tests]), total([bad for _, _, bad, _ in tests])
    score = rounded(f"(1 - {share(broken, checked, 0)} / 100) * 100")
    return Check(measures, (metric(DIMENSION, FORMAT, score, broken, checked, when=f"{checked} > 0"), *parts))

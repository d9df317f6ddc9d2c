"""Completeness: missing cells overall and per column, and blank text."""

from __future__ import annotations

from plumbline.functions.columns import Shape, quoted, rounded, share
from plumbline.functions.text import is_blank
from plumbline.operators.check import Check, metric, total

DIMENSION = "completeness"
OVERALL, BY_COLUMN, BLANKS = "Overall Completeness", "Column Completeness", "Empty String Rate"


def _present(shape: Shape) -> dict[str, str]:
    return {"rows": "count(*)", **{f"present_{i}": f"count({quoted(n)})" for i, n in enumerate(shape.names)}}


def overall(shape: Shape) -> Check:
    """Share of cells that hold a value."""
    present = total([f"present_{i}" for i in range(len(shape.names))])
    cells = f"rows * {len(shape.names)}"
    detail = {"total_cells": cells, "non_null_cells": present, "null_cells": f"{cells} - {present}"}
    value = rounded(share(present, cells, 0))
    return Check(_present(shape), (metric(DIMENSION, OVERALL, value, present, cells, detail=detail),))


def by_column(shape: Shape) -> Check:
    """Share of rows with a value per column; the metric is the mean of the rounded shares."""
    rates = [rounded(share(f"present_{i}", "rows", 0)) for i in range(len(shape.names))]
    parts = [
        metric(DIMENSION, BY_COLUMN, rate, f"present_{i}", "rows", column=name)
        for i, (name, rate) in enumerate(zip(shape.names, rates))
    ]
    mean = rounded(f"CAST({total(rates)} AS DOUBLE) / {max(len(rates), 1)}")
    return Check(_present(shape), (metric(DIMENSION, BY_COLUMN, mean), *parts))


def blanks(shape: Shape) -> Check:
    """Text cells that are blank, over all cells; reported only when there are any."""
    counts = {n: f"blank_{i}" for i, n in enumerate(shape.names) if n in shape.texts}
    found, cells = total(list(counts.values())), f"rows * {len(shape.names)}"
    parts = [metric(DIMENSION, BLANKS, "NULL", c, "rows", column=n, when=f"{c} > 0") for n, c in counts.items()]
    value = rounded(f"100 - {share(found, cells, 0)}")
    return Check(
        {"rows": "count(*)", **{c: f"count_if({is_blank(shape.texts[n])})" for n, c in counts.items()}},
        (metric(DIMENSION, BLANKS, value, found, cells, when=f"{found} > 0"), *parts),
    )

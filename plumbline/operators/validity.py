"""Validity: amounts that must not be negative."""

from __future__ import annotations

from plumbline.functions.columns import Shape, quoted, rounded, share
from plumbline.operators.check import Check, metric, total

DIMENSION = "validity"
RULES = "Business Rule Validity"


def negative_amounts(shape: Shape) -> Check:
    """Negative values of amount-named columns. Every numeric type is tested; the denominator counts
    all columns with such a name, text ones included."""
    tested = {n: f"negative_{i}" for i, n in enumerate(shape.names) if n in shape.amounts and n in shape.numerics}
    found, cells = total(list(tested.values())), f"rows * {len(shape.amounts)}"
    parts = [metric(DIMENSION, RULES, "NULL", c, "rows", column=n, when=f"{c} > 0") for n, c in tested.items()]
    score = rounded(f"(1 - {share(found, cells, 0)} / 100) * 100")
    return Check(
        {"rows": "count(*)", **{c: f"count_if({quoted(n)} < 0)" for n, c in tested.items()}},
        (metric(DIMENSION, RULES, score, found, cells), *parts),
    )

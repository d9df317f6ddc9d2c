"""Consistency: letter case, date parsing and the order of date pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from plumbline.functions.columns import Shape, quoted, rounded, share
from plumbline.functions.text import is_mixed_case
from plumbline.operators.check import Check, metric, total

DIMENSION = "consistency"
CASE, DATES, PAIRS = "Case Consistency", "Date Format Consistency", "Cross-Field Consistency"
PARSED = "Date Parse Rate"

# The column pairs whose first date must not be after the second.
DATE_PAIRS = (("start_date", "end_date"), ("created_at", "updated_at"), ("open_date", "close_date"))


def letter_case(shape: Shape) -> Check:
    """Text columns holding any value that is neither lower, upper nor title case."""
    flags = {n: f"mixed_{i}" for i, n in enumerate(shape.names) if n in shape.texts}
    flagged = total([f"if(coalesce({f}, false), 1L, 0L)" for f in flags.values()])
    width = f"{len(shape.names)}L"
    parts = [metric(DIMENSION, CASE, column=n, when=f"coalesce({f}, false)") for n, f in flags.items()]
    score = rounded(f"100 - {share(flagged, width, 0)}")
    return Check(
        {"rows": "count(*)", **{f: f"bool_or({is_mixed_case(shape.texts[n])})" for n, f in flags.items()}},
        (metric(DIMENSION, CASE, score, flagged, width), *parts),
    )


def parsed_time(shape: Shape, name: str) -> str:
    """SQL for the value as a timestamp, null where it is not one."""
    if name in shape.strings:
        return f"try_to_timestamp({quoted(name)})"
    if name in shape.of_type(T.DateType, T.TimestampType, T.TimestampNTZType):
        return f"CAST({quoted(name)} AS TIMESTAMP)"
    return "CAST(NULL AS TIMESTAMP)"


def date_formats(shape: Shape) -> Check:
    """The score of date-named columns. Unparseable dates read as missing, so it is always 100;
    it is absent without such columns. ``date_parse`` reports what did not parse."""
    if not shape.dates:
        return Check()
    return Check({"rows": "count(*)"}, (metric(DIMENSION, DATES, "100", "0", f"{len(shape.dates)}"),))


def date_parse(shape: Shape) -> Check:
    """Per date-named column the share of present values that parse as a date."""
    measures, parts = {"rows": "count(*)"}, []
    for i, n in enumerate(shape.names):
        if n not in shape.dates:
            continue
        present, parsed = f"present_{i}", f"parsed_{i}"
        measures[present] = f"count({quoted(n)})"
        measures[parsed] = f"count({parsed_time(shape, n)})"
        parts.append(metric(DIMENSION, PARSED, rounded(share(parsed, present, 100)), parsed, present, column=n))
    return Check(measures, tuple(parts))


def date_order(shape: Shape, pairs: Sequence[tuple[str, str]] = DATE_PAIRS) -> Check:
    """Rows whose first date lies after the second, over all rows; the score may fall below zero."""
    known = [(a, b, f"crossed_{i}") for i, (a, b) in enumerate(pairs) if a in shape.names and b in shape.names]
    crossed = total([c for *_, c in known])
    parts = [
        metric(DIMENSION, PAIRS, "NULL", c, "rows", column=f"{a} > {b}", when=f"{c} > 0") for a, b, c in known
    ]
    measures = {c: f"count_if({parsed_time(shape, a)} > {parsed_time(shape, b)})" for a, b, c in known}
    score = rounded(f"(1 - {share(crossed, 'rows', 0)} / 100) * 100")
    return Check({"rows": "count(*)", **measures}, (metric(DIMENSION, PAIRS, score, crossed, "rows"), *parts))

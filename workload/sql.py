"""Small helpers to spell oracle queries."""

from __future__ import annotations

from collections.abc import Iterable

from workload.views import oracle_view

TEXT = ["customer_name", "email", "phone", "zip_code", "open_date", "close_date", "status"]
DIRTY = ["customer_id", "customer_name", "email", "phone", "zip_code", "balance", "open_date", "close_date", "status"]
NOT_TITLE = r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"


def collection():
    """``(queries, oracles, query)``: ``query(name, oracle)`` registers the decorated function."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(function):
            queries[name] = function
            if oracle is not None:
                oracles[name] = oracle
            return function

        return add

    return queries, oracles, query


def rnd(expression: str, digits: int = 2) -> str:
    return f"round_even(CAST({expression} AS DOUBLE), {digits})"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def with_views(names: Iterable[str], *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*(oracle_view(n) for n in names), *ctes]) + "\n"


def union(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def fences(column: str, source: str) -> str:
    """A one-row relation with the outlier fences of a column."""
    return (
        f"SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT "
        f"quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"
    )


def mixed_case(column: str) -> str:
    return (
        f"({column} <> lower({column}) AND {column} <> upper({column}) "
        f"AND regexp_matches({column}, '{NOT_TITLE}'))"
    )


def metric_row(dimension: str, name: str, value: str, source: str) -> str:
    return f"SELECT '{dimension}' AS dimension, '{name}' AS name, {rnd(value)} AS value FROM {source}"


def table_metrics(
    source: str,
    columns: list[str],
    texts: list[str],
    numerics: list[str],
    formats: list[tuple[str, str]],
    dates: list[str],
    pairs: list[tuple[str, str]],
    amounts: list[str],
) -> str:
    """The metrics of a whole table, written out per check."""
    from plumbline.functions.text import FORMATS  # fixed patterns, shared so that both sides test the same

    cells = f"(count(*) * {len(columns)})"
    present = " + ".join(f"count({c})" for c in columns)
    blank = " + ".join(f"count(*) FILTER (regexp_full_match({c}, '\\s*'))" for c in texts) or "0"
    by_column = " + ".join(rnd(f"count({c}) * 100.0 / count(*)") for c in columns)
    parts = [
        metric_row("completeness", "Overall Completeness", f"({present}) * 100.0 / {cells}", source),
        metric_row("completeness", "Column Completeness", f"({by_column}) / {len(columns)}.0", source),
        f"SELECT 'completeness', 'Empty String Rate', {rnd(f'100 - ({blank}) * 100.0 / {cells}')} "
        f"FROM {source} HAVING ({blank}) > 0",
        metric_row("accuracy", "Data Type Consistency", "100.0", f"(SELECT 1)"),
    ]
    outside = " + ".join(
        f"(SELECT count(*) FROM {source}, ({fences(c, source)}) f WHERE {c} < low OR {c} > high)" for c in numerics
    )
    parts.append(metric_row("accuracy", "Numeric Range Accuracy", f"100 - ({outside or 0}) * 100.0 / count(*)", source))
    if formats:
        bad = " + ".join(
            f"count(*) FILTER (NOT regexp_matches({c}, '{FORMATS[kind]}'))" for c, kind in formats
        )
        checked = " + ".join(f"count({c})" for c, _ in formats)
        parts.append(metric_row("accuracy", "Format Accuracy", f"(1 - ({bad}) * 1.0 / ({checked})) * 100", source))
    flagged = " + ".join(f"CAST(coalesce(bool_or({mixed_case(c)}), false) AS INT)" for c in texts) or "0"
    parts.append(metric_row("consistency", "Case Consistency", f"100 - ({flagged}) * 100.0 / {len(columns)}", source))
    if dates:
        parts.append(metric_row("consistency", "Date Format Consistency", "100.0", "(SELECT 1)"))
    crossed = (
        " + ".join(
            f"count(*) FILTER (try_cast({a} AS TIMESTAMP) > try_cast({b} AS TIMESTAMP))" for a, b in pairs
        )
        or "0"
    )
    parts.append(metric_row("consistency", "Cross-Field Consistency", f"(1 - ({crossed}) * 1.0 / count(*)) * 100", source))
    listed = ", ".join(columns)
    parts.append(
        metric_row(
            "uniqueness", "Row Uniqueness",
            "distinct_rows * 100.0 / all_rows",
            f"(SELECT (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source})) AS distinct_rows, "
            f"(SELECT count(*) FROM {source}) AS all_rows)",
        )
    )
    rates = " + ".join(
        f"CASE WHEN count({c}) > 0 THEN {rnd(f'count(DISTINCT {c}) * 100.0 / count({c})')} ELSE 0 END" for c in columns
    )
    parts.append(metric_row("uniqueness", "Column Uniqueness", f"({rates}) / {len(columns)}.0", source))
    negative = " + ".join(f"count(*) FILTER ({c} < 0)" for c in amounts if c in numerics) or "0"
    value = f"(1 - ({negative}) * 1.0 / (count(*) * {len(amounts)})) * 100" if amounts else "100.0"
    parts.append(metric_row("validity", "Business Rule Validity", value, source))
    return union(parts)


DIRTY_METRICS = table_metrics(
    "dirty_customer", DIRTY, TEXT, ["customer_id", "balance"],
    [("email", "email"), ("phone", "phone"), ("zip_code", "zip")],
    ["open_date", "close_date"], [("open_date", "close_date")], ["balance"],
)
WEIGHT = (
    "CASE dimension WHEN 'completeness' THEN 0.25 WHEN 'accuracy' THEN 0.25 WHEN 'consistency' THEN 0.20 "
    "WHEN 'uniqueness' THEN 0.15 WHEN 'validity' THEN 0.15 ELSE 0.1 END"
)

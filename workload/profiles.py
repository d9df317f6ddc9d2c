"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.columns import nan_as_null
from plumbline.operators import profile as p
from plumbline.operators.value_counts import Counted, modes_of, value_counts
from workload.checks import LINEITEM, NUMERIC_LINE, dirty
from workload.sql import DIRTY, TEXT, big, collection, rnd, union, with_views
from workload.views import table

QUERIES, ORACLES, query = collection()
V1 = with_views(["dirty_customer"])
_DTYPE = {"customer_id": "bigint", "balance": "double"}


def _counts(columns: list[str], source: str) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


_TOP = f"""SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({{counts}})) WHERE rank <= 5"""


@query("value_counts", V1 + _counts(DIRTY, "dirty_customer"))
def _(spark, sf):
    return value_counts(dirty(spark, sf)[0], DIRTY)


@query(
    "profile_nulls",
    V1
    + union(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", '{_DTYPE.get(c, 'string')}' AS dtype, count(*) - count({c}) AS null_count,
        {rnd(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_percentage FROM dirty_customer"""
        for i, c in enumerate(DIRTY)
    ),
)
def _(spark, sf):
    return p.null_profile(*dirty(spark, sf))


def _distinct(columns: list[str], source: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
        {rnd(f'count(DISTINCT {c}) * 100.0 / count({c})')} AS unique_percentage FROM {source}"""
        for c in columns
    )


@query("profile_distinct", V1 + _distinct(DIRTY, "dirty_customer"))
def _(spark, sf):
    return p.distinct_profile(*dirty(spark, sf))


def _numeric(columns: list[str], source: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", {rnd(f'avg({c})', 4)} AS mean, {rnd(f'quantile_cont({c}, 0.5)', 4)} AS median,
        {rnd(f'stddev_samp({c})', 4)} AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        {rnd(f'quantile_cont({c}, 0.25)', 4)} AS q25, {rnd(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM {source}"""
        for c in columns
    )


def _rounded(rows):
    return rows.select(
        "column", *[F.bround(c, 4).alias(c) for c in ("mean", "median", "std")], "min", "max",
        *[F.bround(c, 4).alias(c) for c in ("q25", "q75")],
    )


@query("profile_numeric", V1 + _numeric(["customer_id", "balance"], "dirty_customer"))
def _(spark, sf):
    return _rounded(p.numeric_profile(*dirty(spark, sf)))


@query("profile_numeric_lineitem", _numeric(NUMERIC_LINE, "lineitem"))
def _(spark, sf):
    return _rounded(p.numeric_profile(table(spark, sf, "lineitem")))


def _strings(columns: list[str], source: str) -> str:
    return union(
        f"""SELECT '{c}' AS "column", CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER)
        AS max_length, {rnd(f'avg(length({c}))')} AS avg_length FROM {source}"""
        for c in columns
    )


@query("profile_strings", V1 + _strings(TEXT, "dirty_customer"))
def _(spark, sf):
    return p.string_profile(*dirty(spark, sf))


@query("profile_strings_documents", _strings(["text", "lang", "source"], "documents"))
def _(spark, sf):
    return p.string_profile(table(spark, sf, "documents"))


@query(
    "profile_mode",
    V1 + f"""SELECT "column", first(value ORDER BY n DESC, value) AS mode FROM ({_counts(TEXT, 'dirty_customer')}) GROUP BY 1""",
)
def _(spark, sf):
    return modes_of(dirty(spark, sf)[0], TEXT)


@query("profile_top_values", V1 + _TOP.format(counts=_counts(DIRTY, "dirty_customer")))
def _(spark, sf):
    return Counted.of(dirty(spark, sf)[0], DIRTY).top()


@query("profile_top_values_lineitem", _TOP.format(counts=_counts(LINEITEM, "lineitem")))
def _(spark, sf):
    return Counted.of(nan_as_null(table(spark, sf, "lineitem")), LINEITEM).top()


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@query("profile_top_values_documents", _TOP.format(counts=_counts(DOCUMENT, "documents")))
def _(spark, sf):
    """The most frequent values of all columns, whole texts among them."""
    return Counted.of(table(spark, sf, "documents"), DOCUMENT).top()


@query("profile_distinct_documents", _distinct(DOCUMENT, "documents"))
def _(spark, sf):
    return p.distinct_profile(table(spark, sf, "documents"))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in DIRTY)


@query(
    "profile_duplicates",
    V1 + f"""SELECT count(*) AS total_records, {big('sum(extra)')} AS duplicate_count,
    {rnd('sum(extra) * 100.0 / count(*)')} AS duplicate_percentage FROM (
    SELECT CASE WHEN {_COMPLETE} AND row_number() OVER (PARTITION BY {', '.join(DIRTY)}) > 1 THEN 1 ELSE 0 END AS extra
    FROM dirty_customer)""",
)
def _(spark, sf):
    return p.duplicate_profile(*dirty(spark, sf))


def _join(*parts: str) -> str:
    first, *rest = parts
    return f"SELECT * FROM ({first}) " + " ".join(f'LEFT JOIN ({r}) USING ("column")' for r in rest)


# fixed values: the types of the columns as Spark names them
_LINE_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]


@query(
    "profile_lineitem",
    _join(
        union(
            f"""SELECT {i} AS ordinal, '{c}' AS "column", '{kind}' AS dtype, count(*) - count({c}) AS null_count,
            {rnd(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_percentage FROM lineitem"""
            for i, (c, kind) in enumerate(zip(LINEITEM, _LINE_TYPES))
        ),
        _distinct(LINEITEM, "lineitem"),
        _numeric(NUMERIC_LINE, "lineitem"),
        _strings(["l_returnflag", "l_linestatus"], "lineitem"),
        f"SELECT \"column\", first(value ORDER BY n DESC, value) AS mode FROM ({_counts(['l_returnflag', 'l_linestatus'], 'lineitem')}) GROUP BY 1",
        f"""SELECT "column", string_agg(value || ':' || n, ';' ORDER BY rank) AS top_values
        FROM ({_TOP.format(counts=_counts(LINEITEM, 'lineitem'))}) GROUP BY 1""",
    ),
)
def _(spark, sf):
    """The whole profile; the top values as text."""
    rows = p.profile(table(spark, sf, "lineitem"))
    rounded = {c: F.bround(c, 4) for c in ("mean", "median", "std", "q25", "q75")}
    top = F.concat_ws(";", F.transform("top_values", lambda v: F.concat_ws(":", v["value"], v["n"].cast("string"))))
    return rows.withColumns({**rounded, "top_values": top})

"""Duplicate queries: exact, fuzzy and phonetic groups, and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.similarity import text_similarity
from plumbline.functions.text import phonetic_code
from plumbline.operators import merge
from plumbline.operators.exact import exact_groups, exact_members
from plumbline.operators.fuzzy import block_sizes, fuzzy_groups, fuzzy_members, fuzzy_pairs
from plumbline.operators.phonetic import phonetic_groups, phonetic_members
from plumbline.plans.duplicates import duplicate_members, duplicate_stats, find_duplicates
from workload.sql import DIRTY, big, collection, rnd, with_views
from workload.views import table, view

QUERIES, ORACLES, query = collection()
V1, V4 = with_views(["dirty_customer"]), with_views(["part_names"])
_KEYS, COMPLETE = ", ".join(DIRTY), " AND ".join(f"{c} IS NOT NULL" for c in DIRTY)
THRESHOLD = 85.0

# ---- exact groups and merging

SETS = f"""sets AS (SELECT min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS size, {_KEYS}
FROM dirty_customer WHERE {COMPLETE} GROUP BY {_KEYS} HAVING count(*) > 1)"""
_SHORT_KEYS = ["customer_name", "status"]


@query(
    "dedup_exact_groups",
    V1 + f""", {SETS} SELECT CAST(first_row AS VARCHAR) AS group_id, 'exact' AS method, size,
    CAST(100 AS DOUBLE) AS match_score FROM sets""",
)
def _(spark, sf):
    return exact_groups(view(spark, sf, "dirty_customer"), DIRTY, "row_id").select("group_id", "method", "size", "match_score")


@query(
    "dedup_exact_members",
    V1 + """SELECT CAST(min(row_id) OVER w AS VARCHAR) AS group_id, 'exact' AS method, row_id FROM dirty_customer
    WHERE customer_name IS NOT NULL AND status IS NOT NULL WINDOW w AS (PARTITION BY customer_name, status)
    QUALIFY count(*) OVER w > 1""",
)
def _(spark, sf):
    return exact_members(view(spark, sf, "dirty_customer"), _SHORT_KEYS, "row_id")


@query(
    "dedup_exact_lineitem",
    """SELECT CAST(min(l_linenumber + 10 * l_orderkey) AS VARCHAR) AS group_id, count(*) AS size, l_partkey, l_quantity
    FROM lineitem GROUP BY l_partkey, l_quantity HAVING count(*) > 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_linenumber") + 10 * F.col("l_orderkey"))
    groups = exact_groups(rows, ["l_partkey", "l_quantity"], "row_id", show_keys=True)
    return groups.select("group_id", "size", "l_partkey", "l_quantity")


def _merged(pick: str) -> str:
    return V1 + f""", {SETS}, lost AS (SELECT d.row_id FROM dirty_customer d JOIN sets s USING ({_KEYS})
    WHERE d.row_id <> s.{pick}) SELECT * FROM dirty_customer WHERE row_id NOT IN (SELECT row_id FROM lost)"""


@query("merge_first", _merged("first_row"))
def _(spark, sf):
    return merge.merge_exact(view(spark, sf, "dirty_customer"), "row_id", "first")


@query("merge_last", _merged("last_row"))
def _(spark, sf):
    return merge.merge_exact(view(spark, sf, "dirty_customer"), "row_id", "last")


_NULLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in DIRTY)


@query(
    "merge_best",
    V1 + f"""SELECT * FROM dirty_customer WHERE customer_name IS NULL OR status IS NULL UNION ALL
    SELECT * FROM dirty_customer WHERE customer_name IS NOT NULL AND status IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY customer_name, status ORDER BY {_NULLS}, row_id) = 1""",
)
def _(spark, sf):
    return merge.merge_exact(view(spark, sf, "dirty_customer"), "row_id", "best", keys=_SHORT_KEYS)


@query(
    "merge_summary",
    V1 + f""", {SETS} SELECT count(*) AS original_rows, count(*) - (SELECT {big('sum(size - 1)')} FROM sets) AS merged_rows,
    (SELECT {big('sum(size - 1)')} FROM sets) AS removed_duplicates, 'first' AS strategy FROM dirty_customer""",
)
def _(spark, sf):
    return merge.merge_summary(view(spark, sf, "dirty_customer"), "row_id", "first")


# ---- fuzzy groups: the oracle counts common subsequences row by row of the usual table

_BLOCK = "substring(t, 1, 3)"


def _words(text: str) -> str:
    clean = f"trim(lower(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"
    return f"array_to_string(list_sort(string_split_regex({clean}, ' +')), ' ')"


def _similarity(pairs: str) -> list[str]:
    """Relations ending in ``scored(a, b, t_a, t_b, similarity)`` over a relation ``(a, b, t_a, t_b)`` of texts."""
    short, long = "CASE WHEN length(t_a) <= length(t_b) THEN t_a ELSE t_b END", "CASE WHEN length(t_a) <= length(t_b) THEN t_b ELSE t_a END"
    return [
        f"pairs AS ({pairs})",
        f"""spelled AS (SELECT DISTINCT t_a, t_b, {_words('t_a')} AS w_a, {_words('t_b')} AS w_b, {short} AS s, {long} AS l FROM pairs)""",
        """windows AS (SELECT t_a, t_b, s, substring(l, CAST(start AS BIGINT), length(s)) AS part FROM (
          SELECT *, unnest(range(1, length(l) + 1)) AS start FROM spelled))""",
        """problems AS (SELECT t_a AS x, t_b AS y FROM spelled UNION SELECT w_a, w_b FROM spelled
        UNION SELECT s, part FROM windows)""",
        """steps(x, y, i, line) AS (SELECT x, y, 0, list_transform(range(length(y)), lambda j: 0) FROM problems
        UNION ALL SELECT x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(best[1:j])) FROM (
          SELECT x, y, i, list_transform(range(1, length(y) + 1), lambda j: greatest(line[j],
            (CASE WHEN j > 1 THEN line[j - 1] ELSE 0 END) + CAST(substring(y, j, 1) = substring(x, i + 1, 1) AS INT))) AS best
          FROM steps WHERE i < length(x)))""",
        """ratios AS (SELECT x, y, round_even(100 * (2.0 * line[length(y)] / (length(x) + length(y)))::DOUBLE, 0) AS ratio
        FROM steps WHERE i = length(x))""",
        """partial AS (SELECT t_a, t_b, max(ratio) AS p FROM windows JOIN ratios ON x = s AND y = part GROUP BY t_a, t_b)""",
        """blended AS (SELECT t_a, t_b, 0.5::DOUBLE * w.ratio + 0.3::DOUBLE * p + 0.2::DOUBLE * q.ratio AS similarity FROM spelled
        JOIN partial USING (t_a, t_b) JOIN ratios w ON w.x = w_a AND w.y = w_b JOIN ratios q ON q.x = t_a AND q.y = t_b)""",
        "scored AS (SELECT a, b, t_a, t_b, similarity FROM pairs JOIN blended USING (t_a, t_b))",
    ]


_TEXTS = """texts AS (SELECT t, substring(t, 1, 3) AS block, min(p_partkey) AS first_row, count(*) AS n
FROM (SELECT p_partkey, lower(p_name) AS t FROM part_names) GROUP BY t)"""
_IN_BLOCK = """SELECT x.first_row AS a, y.first_row AS b, x.t AS t_a, y.t AS t_b FROM texts x JOIN texts y
ON x.block = y.block AND x.first_row < y.first_row"""


def _fuzzy(*more: str) -> str:
    return with_views(["part_names"], _TEXTS, *_similarity(_IN_BLOCK), *more, recursive=True)


_LED = [
    f"near AS (SELECT a, b FROM scored WHERE similarity >= {THRESHOLD})",
    """ordered AS (SELECT first_row, row_number() OVER (ORDER BY first_row) AS i,
    coalesce((SELECT list(a) FROM near WHERE b = first_row), []) AS earlier FROM texts)""",
    """walk(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN list_has_any(w.leaders, o.earlier)
    THEN w.leaders ELSE list_append(w.leaders, o.first_row) END FROM walk w JOIN ordered o ON o.i = w.i + 1)""",
    """led AS (SELECT first_row, coalesce((SELECT list_min(list_intersect(w.leaders, earlier)) FROM walk w
    WHERE w.i = (SELECT max(i) FROM walk)), first_row) AS leader FROM ordered)""",
    "grouped AS (SELECT leader, first_row, t, n FROM led JOIN texts USING (first_row))",
    """group_scores AS (SELECT leader, size, s + coalesce(between_texts, 0) AS s FROM (
      SELECT leader, CAST(sum(n) AS BIGINT) AS size, sum(n * (n - 1) / 2.0 * 100) AS s FROM grouped GROUP BY leader)
      LEFT JOIN (SELECT x.leader, sum(x.n * y.n * similarity) AS between_texts FROM scored
        JOIN grouped x ON x.first_row = a JOIN grouped y ON y.first_row = b AND x.leader = y.leader GROUP BY x.leader)
      USING (leader))""",
]


@query(
    "fuzzy_similarity",
    with_views(
        ["part_names"],
        *_similarity(
            """SELECT x.p_partkey AS a, y.p_partkey AS b, lower(x.p_name) AS t_a, lower(y.p_name) AS t_b
            FROM part_names x JOIN part_names y ON y.p_partkey = x.p_partkey + 1"""
        ),
        recursive=True,
    )
    + f"SELECT a, b, {rnd('similarity', 4)} AS similarity FROM scored",
)
def _(spark, sf):
    """How alike the names of parts with consecutive keys are."""
    parts = view(spark, sf, "part_names")
    left = parts.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("name_a"))
    right = parts.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("name_b"))
    score = text_similarity([(F.col("name_a"), F.col("name_b"))])
    return left.join(right, "a").select("a", "b", F.bround(score, 4).alias("similarity"))


@query(
    "dedup_block_sizes",
    V4 + f"""SELECT {_BLOCK} AS block, count(*) AS rows, count(DISTINCT t) AS texts
    FROM (SELECT lower(p_name) AS t FROM part_names) GROUP BY 1""",
)
def _(spark, sf):
    return block_sizes(view(spark, sf, "part_names"), ["p_name"], "p_partkey")


@query(
    "dedup_block_sizes_customer",
    V1 + """SELECT array_to_string(list_filter([substring(lower(customer_name), 1, 3), substring(lower(status), 1, 3)],
    lambda v: v <> ''), '_') AS block, count(*) AS rows, count(DISTINCT (lower(coalesce(customer_name, '')), lower(status))) AS texts
    FROM dirty_customer GROUP BY 1""",
)
def _(spark, sf):
    return block_sizes(view(spark, sf, "dirty_customer"), ["customer_name", "status"], "row_id")


@query("fuzzy_pairs", _fuzzy() + f"SELECT a, b, {rnd('similarity', 4)} AS similarity FROM scored WHERE similarity >= {THRESHOLD}")
def _(spark, sf):
    pairs = fuzzy_pairs(view(spark, sf, "part_names"), ["p_name"], "p_partkey", THRESHOLD)
    return pairs.select("a", "b", F.bround("similarity", 4).alias("similarity"))


@query(
    "dedup_fuzzy_groups",
    _fuzzy(*_LED) + f"""SELECT CAST(leader AS VARCHAR) AS group_id, 'fuzzy' AS method, size,
    {rnd('s / (size * (size - 1) / 2.0)')} AS match_score FROM group_scores WHERE size > 1""",
)
def _(spark, sf):
    return fuzzy_groups(view(spark, sf, "part_names"), ["p_name"], "p_partkey", THRESHOLD)


@query(
    "group_similarity",
    _fuzzy(*_LED) + f"""SELECT CAST(leader AS VARCHAR) AS group_id, {rnd('s / (size * (size - 1) / 2.0)')} AS match_score
    FROM group_scores WHERE size > 1""",
)
def _(spark, sf):
    groups = fuzzy_groups(view(spark, sf, "part_names"), ["p_name"], "p_partkey", THRESHOLD)
    return groups.select("group_id", "match_score")


@query(
    "dedup_fuzzy_members",
    _fuzzy(*_LED) + """SELECT CAST(leader AS VARCHAR) AS group_id, 'fuzzy' AS method, p_partkey AS row_id FROM part_names
    JOIN grouped ON t = lower(p_name) JOIN group_scores USING (leader) WHERE size > 1""",
)
def _(spark, sf):
    return fuzzy_members(view(spark, sf, "part_names"), ["p_name"], "p_partkey", THRESHOLD)


def _places(text: str) -> str:
    """For each character of a text a number whose bits are the places that hold it."""
    bits = f"list_transform(range(length({text})), lambda i: CASE WHEN substring({text}, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END)"
    return f"map_from_entries(list_transform(list_distinct(string_split({text}, '')), lambda c: (c, list_sum({bits})::BIGINT)))"


def _common(places: str, size: str, characters: str) -> str:
    """The longest common subsequence of a text of at most 60 characters and a list of characters, a bit a place."""
    full = f"((1::BIGINT << {size}) - 1)"
    hits = f"list_prepend({full}, list_transform({characters}, lambda c: coalesce({places}[c], 0)))"
    return f"({size} - bit_count(list_reduce({hits}, lambda v, u: ((v + (v & u)) | (v - (v & u))) & {full})))"


def _percent(common: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 100 ELSE round_even(100 * (2.0 * {common} / {total})::DOUBLE, 0) END"


_NAMES = [
    """texts AS (SELECT t, substring(t, 1, 3) AS block, min(row_id) AS first_row, count(*) AS n
    FROM (SELECT row_id, lower(coalesce(customer_name, '')) AS t FROM dirty_customer) GROUP BY t)""",
    f"""spelled AS (SELECT *, string_split(t, '') AS c, CAST(length(t) AS INT) AS len, {_places('t')} AS m,
    string_split(w, '') AS wc, CAST(length(w) AS INT) AS wlen, {_places('w')} AS wm FROM (SELECT *, {_words('t')} AS w FROM texts))""",
    f"""pairs AS (SELECT x.first_row AS a, y.first_row AS b, x.t AS t_a, y.t AS t_b, x.len + y.len AS total,
    {_percent(_common('x.wm', 'x.wlen', 'y.wc'), '(x.wlen + y.wlen)')} AS w, least(x.len, y.len) AS len,
    CASE WHEN x.len <= y.len THEN x.m ELSE y.m END AS m, CASE WHEN x.len <= y.len THEN y.c ELSE x.c END AS c
    FROM spelled x JOIN spelled y ON x.block = y.block AND x.first_row < y.first_row)""",
    f"""scored AS (SELECT a, b, t_a, t_b, 0.5::DOUBLE * w + 0.3::DOUBLE * list_max(list_transform(range(1, len(c) + 1),
      lambda k: {_percent(_common('m', 'len', 'c[k : k + len - 1]'), '(len + least(len, len(c) - k + 1))')}))
      + 0.2::DOUBLE * {_percent(_common('m', 'len', 'c'), 'total')} AS similarity FROM pairs)""",
]


@query(
    "dedup_fuzzy_customer",
    with_views(["dirty_customer"], *_NAMES, *_LED, recursive=True)
    + f"""SELECT CAST(leader AS VARCHAR) AS group_id, 'fuzzy' AS method, size, {rnd('s / (size * (size - 1) / 2.0)')} AS match_score
    FROM group_scores WHERE size > 1""",
)
def _(spark, sf):
    """Customer names, nearly all in one block of texts alike to each other."""
    return fuzzy_groups(view(spark, sf, "dirty_customer"), ["customer_name"], "row_id", THRESHOLD)


# ---- phonetic groups


def _code(text: str) -> str:
    upper = f"upper({text})"
    tail = f"regexp_replace(substring({upper}, 2), '[AEIOU]', '', 'g')"
    spelled = f"concat(substring({upper}, 1, 1), {tail})"
    for old, new in (("PH", "F"), ("GH", "F"), ("CK", "K"), ("C", "K"), ("Z", "S")):
        spelled = f"replace({spelled}, '{old}', '{new}')"
    letters = f"string_split({spelled}, '')"
    return f"substring(array_to_string(list_filter({letters}, lambda c, i: i = 1 OR c <> ({letters})[i - 1]), ''), 1, 6)"


@query("phonetic_encode", V1 + f"SELECT row_id, customer_name, CASE WHEN customer_name IS NOT NULL THEN {_code('customer_name')} END AS code FROM dirty_customer")
def _(spark, sf):
    return view(spark, sf, "dirty_customer").select("row_id", "customer_name", phonetic_code(F.col("customer_name")).alias("code"))


@query(
    "dedup_phonetic_groups",
    with_views(
        ["part_names"], _TEXTS,
        f"coded AS (SELECT *, {_code('t')} AS code FROM texts)",
        *_similarity(
            """SELECT x.first_row AS a, y.first_row AS b, x.t AS t_a, y.t AS t_b FROM coded x JOIN coded y
            ON x.code = y.code AND x.first_row < y.first_row"""
        ),
        recursive=True,
    )
    + f"""SELECT CAST(first_row AS VARCHAR) AS group_id, 'phonetic' AS method, code, size,
    {rnd('(s + coalesce(between_texts, 0)) / (size * (size - 1) / 2.0)')} AS match_score FROM (
      SELECT code, min(first_row) AS first_row, CAST(sum(n) AS BIGINT) AS size, sum(n * (n - 1) / 2.0 * 100) AS s
      FROM coded GROUP BY code HAVING sum(n) > 1)
    LEFT JOIN (SELECT x.code, sum(x.n * y.n * similarity) AS between_texts FROM scored JOIN coded x ON x.first_row = a
      JOIN coded y ON y.first_row = b GROUP BY x.code) USING (code)""",
)
def _(spark, sf):
    return phonetic_groups(view(spark, sf, "part_names"), ["p_name"], "p_partkey")


@query(
    "dedup_phonetic_members",
    V1 + f"""SELECT CAST(min(row_id) OVER w AS VARCHAR) AS group_id, 'phonetic' AS method, row_id FROM (
    SELECT row_id, {_code('customer_name')} AS code FROM dirty_customer WHERE customer_name <> '')
    WINDOW w AS (PARTITION BY code) QUALIFY count(*) OVER w > 1""",
)
def _(spark, sf):
    return phonetic_members(view(spark, sf, "dirty_customer"), ["customer_name"], "row_id")


# ---- several methods together

_PHONETIC_SIZES = f"""coded AS (SELECT {_code('p_name')} AS code, count(*) AS size FROM part_names GROUP BY 1 HAVING count(*) > 1)"""
_EXACT_SIZES = "exact_sets AS (SELECT p_name, count(*) AS size FROM part_names GROUP BY 1 HAVING count(*) > 1)"


@query(
    "dedup_stats",
    _fuzzy(*_LED, _PHONETIC_SIZES, _EXACT_SIZES)
    + f"""SELECT count(*) AS total_groups, {big('sum(size)')} AS total_duplicate_records,
    count(*) FILTER (method = 'exact') AS exact_groups, count(*) FILTER (method = 'fuzzy') AS fuzzy_groups,
    count(*) FILTER (method = 'phonetic') AS phonetic_groups, {rnd('avg(size)')} AS avg_group_size FROM (
      SELECT 'exact' AS method, size FROM exact_sets UNION ALL SELECT 'fuzzy', size FROM group_scores WHERE size > 1
      UNION ALL SELECT 'phonetic', size FROM coded)""",
)
def _(spark, sf):
    found = find_duplicates(
        view(spark, sf, "part_names"), "p_partkey", text_columns=["p_name"], methods=("exact", "fuzzy", "phonetic"),
        threshold=THRESHOLD,
    )
    return duplicate_stats(found).drop("avg_match_score")


@query(
    "merge_all_methods",
    _fuzzy(*_LED) + f""", members AS (
      SELECT 'exact' AS method, p_name AS g, p_partkey AS id FROM part_names
      UNION ALL SELECT 'fuzzy', CAST(leader AS VARCHAR), p_partkey FROM part_names JOIN grouped ON t = lower(p_name)
      UNION ALL SELECT 'phonetic', {_code('p_name')}, p_partkey FROM part_names),
    lost AS (SELECT id FROM members QUALIFY row_number() OVER (PARTITION BY method, g ORDER BY id) > 1)
    SELECT p_partkey, p_name FROM part_names WHERE p_partkey NOT IN (SELECT id FROM lost)""",
)
def _(spark, sf):
    parts = view(spark, sf, "part_names")
    members = duplicate_members(
        parts, "p_partkey", ["p_name"], ["p_name"], ("exact", "fuzzy", "phonetic"), THRESHOLD
    )
    return merge.merge_members(parts, members, "p_partkey", "first")

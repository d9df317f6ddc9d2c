import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates, merge
from plumbline.operators.exact import exact_groups, exact_members
from plumbline.operators.value_counts import distinct_counts, top_values, value_counts
from plumbline.plans import scale


def rows_of(seed: int, n: int):
    rng = random.Random(seed)
    hot = ("hot", 1, None, 2.0)
    return [
        (i, *(hot if rng.random() < 0.34 else (rng.choice("abc"), rng.randint(0, 9), rng.choice([None, 1, 2]), rng.choice([0.0, -0.0, None]))))
        for i in range(n)
    ]


SCHEMA = "id bigint, a string, b int, c int, d double"
KEYS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("max_rows", [200_000, 3, 0])
@pytest.mark.parametrize("keys", [KEYS, ["a", "c"], ["c"]])
def test_members_of_duplicate_sets(spark, monkeypatch, max_rows, keys):
    monkeypatch.setattr(scale, "HOT_SHARE", 10)
    rows = rows_of(1, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    at = [KEYS.index(k) + 1 for k in keys]
    key = lambda r: tuple(r[i] for i in at)
    keyed = [key(r) for r in rows]
    expected = sorted(r[0] for r in rows if keyed.count(key(r)) > 1)
    found = duplicates.duplicate_rows(df, keys, max_rows=max_rows)
    assert sorted(r["id"] for r in found.collect()) == expected
    assert found.columns == df.columns
    whole = [k for k in keyed if None not in k]
    expected = sorted(r[0] for r in rows if None not in key(r) and whole.count(key(r)) > 1)
    found = duplicates.duplicate_rows(df, keys, nulls_equal=False, max_rows=max_rows)
    assert sorted(r["id"] for r in found.collect()) == expected


@pytest.mark.parametrize("bits", [26, 7])
def test_filter_lets_all_digests_through(spark, monkeypatch, bits):
    monkeypatch.setattr(duplicates, "FILTER_BITS", bits)
    rows = spark.range(2000).selectExpr("id", "xxhash64(id) AS __digest")
    kept = duplicates.digest_filter(rows.where("id < 300"), bits)
    assert kept.count() <= 1 << max(0, bits - 6)
    found = {r["id"] for r in duplicates.passing(rows, kept, bits).collect()}
    assert set(range(300)) <= found and (bits == 7 or len(found) < 310)


def test_rows_without_a_twin_do_not_move(spark):
    """One plan whatever the table holds: digests are counted, rows that pass the filter move once, by their keys."""
    df = spark.range(3000).selectExpr("id", "concat('text ', cast(id % 2900 as string)) AS a", "id % 2900 AS b")
    plan = duplicates.duplicate_sets(df, ["a", "b"], nulls_equal=True)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) == 1 and "BroadcastHashJoin" in plan.split("Exchange hashpartitioning")[1]
    merged = duplicates.one_of_each(df, ["a", "b"], F.min("id").alias("id"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and merged.count() == 2900
    # joining the rows of many sets moves only what passes the filter
    found = duplicates.in_duplicate_sets(df, ["a", "b"], F.min("id").alias("first"), nulls_equal=True, max_rows=0)
    assert sorted(r["id"] for r in found.collect()) == [*range(100), *range(2900, 3000)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan or "GetBit" in plan.replace("bitwise_get", "GetBit") or "__mask" in plan


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """A hash of the second column only makes unequal rows collide; results must not change."""
    rows = rows_of(4, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    exact = sorted(r["id"] for r in duplicates.duplicate_rows(df, KEYS).collect())
    members = sorted(map(tuple, exact_members(df, KEYS, "id").collect()))
    merged = sorted(r["id"] for r in merge.merge_exact(df, "id").collect())
    weak = lambda frame, keys: frame.withColumn(duplicates.DIGEST, F.xxhash64("b"))
    monkeypatch.setattr(duplicates, "with_digest", weak)
    assert sorted(r["id"] for r in duplicates.duplicate_rows(df, KEYS).collect()) == exact
    assert sorted(map(tuple, exact_members(df, KEYS, "id").collect())) == members
    assert sorted(r["id"] for r in merge.merge_exact(df, "id").collect()) == merged


def test_join_counted_keys_all_ways(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else str(i % 5))) for i in range(100)], "i int, k string")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"))
    expected = sorted((r["i"], r["n"]) for r in scale.join_counted_keys(rows, keys, ["k"]).collect())
    assert len(expected) == 100
    monkeypatch.setattr(scale, "HOT_SHARE", 4)
    split = scale.join_counted_keys(rows, keys, ["k"], max_rows=0)
    assert sorted((r["i"], r["n"]) for r in split.collect()) == expected


@pytest.mark.parametrize("strategy", ["first", "last", "best"])
def test_merge_on_some_keys(spark, strategy):
    rows = rows_of(2, 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keys = ["a", "b"]
    groups: dict = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r)
    kept = []
    for members in groups.values():
        pick = {"first": members[0], "last": members[-1], "best": min(members, key=lambda r: (sum(v is None for v in r[1:]), r[0]))}
        kept.append(pick[strategy][0])
    assert sorted(r["id"] for r in merge.merge_exact(df, "id", strategy, keys).collect()) == sorted(kept)


@pytest.mark.parametrize("strategy", ["first", "last", "best"])
def test_merge_on_all_columns(spark, strategy):
    rows = rows_of(3, 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1:] if None not in r[1:] else r, []).append(r[0])
    kept = sorted(m[-1] if strategy == "last" else m[0] for m in groups.values())
    assert sorted(r["id"] for r in merge.merge_exact(df, "id", strategy).collect()) == kept
    members = exact_members(df, KEYS, "id")
    assert sorted(r["id"] for r in merge.merge_members(df, members, "id", strategy).collect()) == kept
    summary = merge.merge_summary(df, "id", strategy).first()
    assert tuple(summary) == (200, len(kept), 200 - len(kept), strategy)
    with pytest.raises(ValueError):
        merge.merge_exact(df, "id", "random")


def test_groups_drop_rows_independently(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id int, v string")
    members = spark.createDataFrame([("g", "exact", 1), ("g", "exact", 2), ("h", "fuzzy", 2), ("h", "fuzzy", 3)], "group_id string, method string, row_id int")
    assert sorted(r["id"] for r in merge.merge_members(df, members, "id").collect()) == [1, 4]


def test_exact_groups(spark):
    df = spark.createDataFrame([(5, "x", 1.0), (3, "x", 1.0), (4, "x", None), (6, "x", None), (7, "y", float("nan")), (8, "y", float("nan"))], "id int, a string, b double")
    groups = exact_groups(df, ["a", "b"], "id").collect()
    assert [(g["group_id"], g["size"], g["match_score"]) for g in groups] == [("3", 2, 100.0)]
    assert exact_groups(df, ["a"], "id").count() == 2


def test_value_counts(spark):
    df = spark.createDataFrame([(1, "a", 0.0, True), (1, "b", -0.0, None), (2, "a", 1.5, None), (None, None, None, None)], "i int, s string, d double, f boolean")
    found = {(r["column"], r["value"]): r["n"] for r in value_counts(df).collect()}
    assert found == {("i", "1"): 2, ("i", "2"): 1, ("s", "a"): 2, ("s", "b"): 1, ("d", "0.0"): 2, ("d", "1.5"): 1, ("f", "true"): 1}
    counts = {r["column"]: (r["distinct"], r["present"]) for r in distinct_counts(df, df.columns).collect()}
    assert counts == {"i": (2, 3), "s": (2, 3), "d": (2, 3), "f": (1, 1)}
    rough = {r["column"]: (r["distinct"], r["present"]) for r in distinct_counts(df, ["i", "s", "f"], approximate=True).collect()}
    assert rough == {"i": (2, 3), "s": (2, 3), "f": (1, 1)}
    top = top_values(value_counts(df, ["s"]), k=1).collect()
    assert [(r["value"], r["n"]) for r in top] == [("a", 2)]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_long_texts_are_counted_by_digest(spark, monkeypatch, k):
    from collections import Counter as Times

    from plumbline.operators import value_counts as vc

    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.choice([50, 60, 200])))
    pool = [word() for _ in range(8)]
    rows = [(word() if i % 3 else rng.choice(pool), rng.choice(pool[:4]), word(), rng.choice(["x", "y", None]), "", f"{i:060}" if i < 40 else "z" * 60) for i in range(150)]
    rows += [(None, None, None, None, None, None)] * 3
    names = ["mixed", "few", "all different", "short", "empty", "hot"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).repartition(4)

    def check():
        counted = vc.Counted.of(df, names)
        assert counted.digests is not None
        distinct = {r["column"]: (r["distinct"], r["present"]) for r in counted.distinct().collect()}
        top = sorted((r["column"], r["rank"], r["value"], r["n"]) for r in counted.top(k).collect())
        want = []
        for i, name in enumerate(names):
            times = Times(r[i] for r in rows if r[i] is not None)
            assert distinct[name] == (len(times), sum(times.values()))
            ranked = sorted(times.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
            want += [(name, rank + 1, value, n) for rank, (value, n) in enumerate(ranked)]
        assert top == sorted(want)

    check()
    # digests that several texts share are noticed and counted by text
    strong, plain = F.xxhash64, vc.F
    weak = lambda *columns: strong(*columns) if len(columns) > 1 else F.length(columns[0]).cast("bigint")
    monkeypatch.setattr(vc, "F", type("Weak", (), {"__getattr__": lambda self, name: weak if name == "xxhash64" else getattr(plain, name)})())
    check()


def test_long_texts_do_not_move_whole(spark):
    from plumbline.operators.value_counts import Counted

    df = spark.range(500).selectExpr("concat(repeat('long text ', 9), cast(id % 400 as string)) AS t", "id")
    counted = Counted.of(df, ["t", "id"])
    plan = counted.distinct()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(column" in plan and "t#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert {r["column"]: r["distinct"] for r in counted.distinct().collect()} == {"t": 400, "id": 500}
